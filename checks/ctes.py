"""The derived tables and the engine's steps as SQL, independent of the Spark code."""

from __future__ import annotations

import glob
import os
import re
import zipfile

import pyspark

from vigia import fixed
from vigia.dims import alias_forms, default_brands
from vigia.functions.text import token_literal

from checks.inputs import FOREIGN, LEADS, NOW_SQL, PROVIDERS, SENDERS


def lit(value) -> str:
    if value is None:
        return "null"
    return "'" + str(value).replace("'", "''") + "'"


def cases(index: str, values) -> str:
    return f"case {index} " + " ".join(
        f"when {i} then {lit(v)}" for i, v in enumerate(values)) + " end"


def any_of(values) -> str:
    return "(" + ",".join(lit(v) for v in values) + ")"


def matches(text: str, pattern: str, flags: str = "(?s)") -> str:
    return f"regexp_matches({text}, {lit(flags + pattern)})"


_ZERO = "[" + "".join(
    rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in fixed.ZERO_WIDTH_RANGES) + "]"
_SPACED = r"(?i)\b(?:[a-záéíóúüñ]\s+){2,}[a-záéíóúüñ]\b"
_WORD = r"[\p{L}\p{N}_-]+"


def fold(text: str) -> str:
    return (f"strip_accents(regexp_replace(translate({text}, {lit(fixed.CONFUSABLE_FROM)}, "
            f"{lit(fixed.CONFUSABLE_TO)}), {lit(_ZERO)}, '', 'g'))")


def detection(text: str) -> str:
    joined = (
        f"list_reduce(list_prepend({fold(text)}, regexp_extract_all({fold(text)}, {lit(_SPACED)})), "
        f"lambda acc, m: replace(acc, m, regexp_replace(m, '\\s+', '', 'g')))")
    leet = (
        f"array_to_string(list_transform(regexp_extract_all({joined}, "
        f"{lit(_WORD + '|' + '[^' + _WORD[1:-2] + ']+')}), "
        f"lambda t: case when regexp_matches(t, '[A-Za-z]') and regexp_full_match(t, '[A-Za-z0-9_-]+') "
        f"then translate(t, '{fixed.LEET_FROM}', '{fixed.LEET_TO}') else t end), '')")
    apps = f"regexp_replace({leet}, {lit(fixed.SPLIT_APP_NAME)}, '\\1\\2', 'g')"
    return f"replace(lower(trim(regexp_replace({apps}, '\\s+', ' ', 'g'))), 'ß', 'ss')"


def action(view: str) -> str:
    sql = "case "
    for name, pattern in fixed.ACTIONS:
        test = matches(view, pattern)
        if name == "dar_codigo":
            near = f"right(regexp_extract({view}, {lit('(?s)^(.*?)(?:' + pattern + ')')}, 1), 15)"
            test += " and not (" + " or ".join(
                f"contains({near}, {lit(n)})" for n in fixed.NEGATIONS) + ")"
        sql += f"when {test} then {lit(name)} "
    return sql + "else 'ninguna' end"


def token(text: str) -> str:
    return (f"regexp_replace(replace(strip_accents(translate(lower({text}), "
            f"{lit(fixed.CONFUSABLE_FROM)}, {lit(fixed.CONFUSABLE_TO)})), 'ß', 'ss'), "
            f"'[^a-z0-9]', '', 'g')")


_BRANDS = ",".join(
    f"({i}, {lit(b.name)}, {lit(b.category)}, {[*b.tokens]}, {[*b.domains]}, "
    f"{[token_literal(d.split('.')[0]) for d in b.domains]})"
    for i, b in enumerate(default_brands()))
_EDGE = r"[^\p{L}\p{N}_]"


def claimed(view: str) -> str:
    """Position of the brand whose longest alias occurs as a whole word (aliases come longest first)."""
    return "case " + " ".join(
        f"when contains({view}, {lit(a)}) and regexp_matches({view}, "
        f"{lit('(^|' + _EDGE + ')' + re.sub(r'([^a-z0-9 ])', lambda m: chr(92) + m.group(1), a) + '($|' + _EDGE + ')')}) then {i}"
        for a, i in alias_forms(default_brands())) + " end"


_IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"


def host(url: str) -> str:
    full = f"(case when contains({url}, '://') then {url} else 'https://' || {url} end)"
    return (f"nullif(rtrim(lower(regexp_extract({full}, "
            f"'^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.'), '')")


def suffix_list() -> list[str]:
    """The public list as Spark's HTTP client carries it, read here from the archive itself."""
    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars", "httpclient-4*.jar")
    if not glob.glob(jars):  # then the engine falls back to the built-in list, too
        return [*fixed.TWO_LABEL_SUFFIXES, *fixed.EXTRA_SUFFIXES, "com", "net", "org", "es"]
    with zipfile.ZipFile(glob.glob(jars)[0]) as archive:
        lines = archive.read("mozilla/public-suffix-list.txt").decode().splitlines()
    return [w.split()[0] for w in lines if w.strip() and not w.startswith("//")] + list(fixed.EXTRA_SUFFIXES)


def _suffix_rules() -> str:
    rules = sorted({spelled for r in suffix_list() for spelled in (r, r.encode("idna").decode() if r.isascii() else
                    ("!" if r[0] == "!" else "*." if r[:2] == "*." else "") + r.lstrip("!").removeprefix("*.").encode("idna").decode())})
    return f"""select regexp_replace(r, '^(!|[*][.])', '') as rule, len(string_split(r, '.')) as rule_n,
      case when r like '!%' then 'x' when r like '*.%' then 'w' else 'e' end as rule_kind
      from (select unnest(string_split({lit(' '.join(rules))}, ' ')) as r)"""


def registrable(name: str) -> str:
    """The longest rule whose name ends the host, by a look at every rule."""
    best = (f"(select max(case when rule_kind = 'x' then 999 + rule_n else rule_n end) % 1000 from suffix_rules where "
            f"({name} = rule and rule_kind <> 'w') or ends_with({name}, '.' || rule))")
    return (f"case when regexp_matches({name}, {lit(_IPV4)}) then {name} else "
            f"array_to_string(string_split({name}, '.')[-(coalesce({best}, 900) + 1):], '.') end")


def idna(name: str) -> str:
    """ASCII form of the international names that the checks use."""
    for written, ascii_form, _ in FOREIGN:
        if written != ascii_form:
            name = f"replace({name}, {lit(written)}, {lit(ascii_form)})"
    return name


def path(url: str) -> str:
    return (f"regexp_extract((case when contains({url}, '://') then {url} else 'https://' || {url} "
            f"end), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)")


def query(url: str) -> str:
    return f"regexp_extract({url}, '^[^?#]*[?]([^#]*)', 1)"


def canonical(url: str) -> str:
    """For http(s) links; the usual ports and the user part go."""
    port = f"regexp_extract({url}, '^[a-z]+://(?:[^/?#@]*@)?[^/?#:]*(:[0-9]+)', 1)"
    return (f"case when {url} like 'http%://%' and not regexp_matches({host(url)}, '\\.[0-9]+$') then "
            f"regexp_extract({url}, '^(https?://)', 1) || {idna(host(url))} || "
            f"case when {port} in (':80', ':443') then '' else {port} end || "
            f"coalesce(nullif({path(url)}, ''), '/') || "
            f"case when {query(url)} = '' then '' else '?' || {query(url)} end end")


def ordered_distinct(array: str) -> str:
    return f"list_filter({array}, lambda x, i: list_position({array}, x) = i)"


_NUMBER = f"page_id % {len(FOREIGN)}"
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "suffix_rules": ((), _suffix_rules()),
    "foreign_pages": ((), f"""
        select page_id, 'f' || page_id as message_id, {_NUMBER} as k, {cases(_NUMBER, [f[0] for f in FOREIGN])} as ending,
          coalesce({cases(_NUMBER, [f[2] for f in FOREIGN])}, 'p' || page_id || '.' || {cases(_NUMBER, [f[0] for f in FOREIGN])}) as domain,
          case when page_id % 2 = 0 then 'https://' else 'http://' end || case when page_id % 3 = 0 then 'usuario:clave@' else '' end
            || 'p' || page_id || '.' || {cases(_NUMBER, [f[0] for f in FOREIGN])}
            || case page_id % 4 when 0 then ':8443' when 1 then ':443' else '' end || '/a/' || page_id as url
        from pages"""),
    "messages": ((), f"""
        select 'm' || d.doc_id as message_id, d.doc_id, d.lang,
          concat_ws(' ', {cases(f'd.doc_id % {len(LEADS)}', LEADS)}, d.text, p.url) as body,
          {cases(f'd.doc_id % {len(SENDERS)}', SENDERS)} as sender,
          e.ts as received_at, e.user_id::varchar as user_reference
        from documents d join pages p on p.page_id = d.doc_id % (select count(*) from pages)
          join events e on e.event_id = d.doc_id"""),
    "viewed": (("messages",), f"select *, {detection('body')} as detection from messages"),
    "brands": ((), f"""
        select * from (values {_BRANDS})
        t(brand_order, entity, category, tokens, official_domains, official_labels)"""),
    "claims": (("viewed",), f"select message_id, {claimed('detection')} as brand_order from viewed"),
    "facts": (("viewed", "claims", "brands"), f"""
        select v.*, {action('v.detection')} as requested_action,
          list_filter([{','.join(
              f"case when contains(v.detection, {lit(s)}) then {lit(shown)} end"
              for shown, s in fixed.URGENCY)}], lambda x: x is not null) as urgency_markers,
          list_transform(regexp_extract_all(v.body, {lit('(?i)' + fixed.URL)}),
            lambda u: rtrim(u, {lit(fixed.URL_TRAILING)})) as all_urls,
          case when regexp_matches(replace(v.sender, ' ', ''), '[0-9]{{6,}}') then v.sender end
            as sender_number,
          case when not regexp_matches(replace(v.sender, ' ', ''), '[0-9]{{6,}}') then v.sender end
            as sender_alias,
          b.entity as claimed_entity, b.category, b.tokens, b.official_domains, b.official_labels
        from viewed v left join claims c using (message_id) left join brands b using (brand_order)"""),
    "read": (("facts",), f"select *, {ordered_distinct('all_urls')} as urls from facts"),
    "raw_links": (("read",), """
        select message_id, claimed_entity, tokens, official_domains, official_labels,
          unnest(urls) as url, generate_subscripts(urls, 1) - 1 as position from read"""),
    "hosted": (("raw_links",), f"select *, {host('url')} as host from raw_links"),
    "links": (("hosted",), f"""
        select *, {registrable('host')} as domain, {canonical('url')} as canonical_url
        from hosted where host is not null"""),
    "feed_lines": ((), """
        select page_id, url, case page_id % 4
          when 0 then '127.0.0.1 ' || h when 1 then '0.0.0.0' || chr(9) || upper(h)
          when 2 then h || ' 10.0.0.1' else '# ' || h end as value
        from (select page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) h from pages)"""),
    "indicators": ((), f"""
        select provider, provider || '-last' as snapshot_id, indicator_type,
          sha256(value_public) as value_hash, value_public,
          case when bool_and(gone) then 'inactive' else 'active' end as status,
          min(ts) as first_seen, max(ts) as last_seen
        from (select {cases(f'p.page_id % {len(PROVIDERS)}', PROVIDERS)} as provider,
            case when p.page_id % 2 = 0 then 'url' else 'domain' end as indicator_type,
            case when p.page_id % 2 = 0 then regexp_replace(url, '#.*$', '')
              else array_to_string(string_split(regexp_extract(url, '^https?://([^/?#]*)', 1), '.')[-3:], '.')
            end as value_public, e.ts, p.page_id % 7 = 0 as gone
          from pages p join events e on e.event_id = p.page_id)
        group by provider, indicator_type, value_public"""),
    "hourly": ((), f"""
        select {cases(f'user_id % {len(PROVIDERS)}', PROVIDERS)} as provider,
          date_trunc('hour', ts) as fetched_at, bool_or(event_type <> 'error') as succeeded,
          count(*) as entry_count from events group by 1, 2"""),
    "snapshots": (("hourly",), f"""
        select provider || '-' || epoch(fetched_at)::bigint as snapshot_id, provider, 'v1' as version,
          entry_count, fetched_at::timestamp as fetched_at, succeeded from hourly
        where fetched_at < {NOW_SQL} - interval 2 days
        union all
        select distinct provider || '-last', provider, 'v2', 1, {NOW_SQL} - to_seconds(
          case provider when 'urlhaus' then 600 when 'openphish' then 90000
            when 'urlhaus_hosts' then 1700 when 'destroylist' then 3600 else 21600 end), true
        from hourly"""),
    "policies": ((), "select * from (values " + ",".join(
        f"({lit(p['provider'])}, {str(p['hard_rule_eligible']).lower()}, {p['ttl_seconds']})" for p in fixed.PROVIDERS)
        + ") t(provider, hard_rule_eligible, ttl_seconds)"),
    "latest": (("snapshots",), """
        select provider, arg_max(snapshot_id, fetched_at) as snapshot_id,
          arg_max(version, fetched_at) as version, max(fetched_at) as fetched_at
        from snapshots where succeeded group by provider"""),
    "provider_state": (("latest", "policies"), f"""
        select l.provider, l.version, greatest(0, epoch({NOW_SQL}) - epoch(fetched_at))::bigint
            as age_seconds,
          greatest(0, epoch({NOW_SQL}) - epoch(fetched_at)) <= coalesce(ttl_seconds, 21600) as fresh,
          coalesce(hard_rule_eligible, false) as hard_rule_eligible
        from latest l left join policies using (provider)"""),
}


def sql(select: str, *needs: str, extra: dict[str, str] | None = None) -> str:
    """``select`` with the common tables it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    wanted = [select, *(extra or {}).values()]
    for need in needs:
        visit(need)
    if "suffix_rules" in " ".join([*wanted, *(CTES[n][1] for n in ordered)]):
        ordered.remove("suffix_rules") if "suffix_rules" in ordered else None
        ordered.insert(0, "suffix_rules")
    parts = [f"{n} as materialized ({CTES[n][1]})" for n in ordered]
    parts += [f"{n} as materialized ({body})" for n, body in (extra or {}).items()]
    return (f"with {', '.join(parts)} " if parts else "") + select
