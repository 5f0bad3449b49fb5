"""Links, brands, evidence and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigia import fixed, schemas as S
from vigia.dims import default_aliases
from vigia.functions.text import token_literal
from vigia.operators import evidence, extract, intel, scoring
from vigia.plans.score import ScoreOptions, judge, links_of, read_messages, score_messages

from checks import ctes, text as text_checks
from checks.ctes import lit, matches, sql
from checks.inputs import NOW, NOW_SQL, events, foreign_urls, messages, table

WITH_ALIASES = ScoreOptions(aliases=default_aliases())


def scored(spark, sf):
    return score_messages(messages(spark, sf), options=WITH_ALIASES)


# --- links ---------------------------------------------------------------------------------------

def url_facts(spark, sf):
    """Every page address, every link of the messages and the international links."""
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("message_id"), F.col("url").alias("body"))
    foreign = foreign_urls(spark, sf).select("message_id", F.col("url").alias("body"))
    both = pages.unionByName(messages(spark, sf).select("message_id", "body")).unionByName(foreign)
    return links_of(both).select(
        "message_id", "position", "url", "host", "domain", "canonical_url", "path_template",
        "url_length", "label_count", "path_depth", "label_entropy",
        F.array_join("suffix_candidates", " ").alias("suffixes"))


_LABEL = ("list_reduce(string_split(host, '.'), lambda a, b: case when length(b) > length(a) "
          "then b else a end)")
_CHARS = f"list_distinct(string_split(lower({_LABEL}), ''))"
_COUNT = (f"(length({_LABEL}) - length(replace(lower({_LABEL}), c, '')))::double / length({_LABEL})")
ENTROPY = f"round(list_sum(list_transform({_CHARS}, lambda c: -({_COUNT}) * log2({_COUNT}))), 3)"
DEPTH = f"len(list_filter(string_split({ctes.path('url')}, '/'), lambda x: x <> ''))"
_SEGMENT = r"^(?:[0-9]{4,}|[0-9a-fA-F]{8,}|[A-Za-z0-9_-]{20,})$"
_KEYS = (
    f"list_transform(list_filter(string_split({ctes.query('url')}, '&'), lambda p: regexp_matches(p, '=.')), "
    f"lambda p: lower(string_split(p, '=')[1]))")
TEMPLATE = (
    "case when regexp_matches(url, '^[a-z]+://([^/?#]*@|[^/?#]*:8443)') then null else "
    f"domain || coalesce(nullif(array_to_string(list_transform(string_split({ctes.path('url')}, '/'), "
    f"lambda s: case when regexp_matches(s, '{_SEGMENT}') then '{{token}}' else lower(s) end), '/'), ''), '/') "
    f"|| case when len({_KEYS}) > 0 then '?' || array_to_string(list_sort(list_distinct({_KEYS})), '&') "
    f"else '' end end")
_LINK_SQL = f"""select message_id, position, url, host, domain, canonical_url, {TEMPLATE} as path_template,
  length(url) as url_length, len(string_split(host, '.')) as label_count, {DEPTH} as path_depth,
  {ENTROPY} as label_entropy, array_to_string(list_transform(
    range(1, greatest(len(string_split(domain, '.')), 2)),
    lambda i: array_to_string(string_split(domain, '.')[i:], '.')), ' ') as suffixes from all_links"""
_ALL_LINKS = f"""select *, {ctes.registrable(ctes.idna('host'))} as domain, {ctes.canonical('url')} as canonical_url
  from (select *, {ctes.host('url')} as host from (
    select message_id, url, position from raw_links union all
    select 'p' || page_id, url, 0 from pages union all select message_id, url, 0 from foreign_pages))"""


def brand_match(spark, sf):
    """Page domains against the brand that page number points at, by name or alias."""
    pages = table(spark, sf, "pages")
    from vigia.dims import default_brands
    names = [b.name for b in default_brands()]
    from checks.inputs import choose
    named = pages.select(
        "page_id", F.concat(
            F.when(F.col("page_id") % 3 == 0, "caixabnk.es").when(F.col("page_id") % 3 == 1, "www.bbva.es")
            .otherwise(F.regexp_extract("url", "//([^/?#]*)", 1))).alias("domain"),
        choose(F.col("page_id") % len(names), names).alias("claimed_entity"))
    rows = extract.official_contacts(extract.match_brands(named))
    return rows.select("page_id", "entity", "category", F.col("is_official").cast("int").alias("official"),
                       "similarity", F.size("official_verification.official_domains").alias("n_domains"))


def _brand_sql() -> str:
    from vigia.dims import default_brands
    names = [b.name for b in default_brands()]
    return f"""select page_id, entity, category,
      (len(list_filter(official_domains, lambda d: domain = d or domain like '%.' || d)) > 0)::int as official,
      round(list_max(list_transform(official_labels, lambda o: 1 - levenshtein(c, o)::double /
        greatest(length(c), length(o), 1))), 3) as similarity, len(official_domains)::int as n_domains
    from (select *, {ctes.token("string_split(domain, '.')[1]")} as c from (
      select page_id, case page_id % 3 when 0 then 'caixabnk.es' when 1 then 'www.bbva.es'
        else regexp_extract(url, '//([^/?#]*)', 1) end as domain,
        {ctes.cases(f'page_id % {len(names)}', names)} as name from pages)) p
    join brands b on b.entity = p.name"""


# --- evidence in SQL -----------------------------------------------------------------------------

_ALIAS_ROWS = ",".join(
    f"({lit(token_literal(a.alias))}, {lit(a.holder)}, {lit(token_literal(a.holder))}, "
    f"{[token_literal(n) for n in a.authorized]})" for a in default_aliases())


def _link_hit(name: str, weight, test: str, summary: str, k: int, hard: str = "false") -> str:
    return (f"select message_id, {100 + k} + position * 20 as ordinal, '{name}' as check_name, "
            f"({weight})::int as weight, {hard} as hard_rule, true as telling, {summary} as summary, domain "
            f"from flagged where {test}")


def _text_hit(name: str, weight, test: str, summary: str, ordinal: int, hard: str = "false",
              telling: str = "true") -> str:
    return (f"select message_id, {ordinal} as ordinal, '{name}' as check_name, ({weight})::int as weight, "
            f"{hard} as hard_rule, {telling} as telling, {summary} as summary, null as domain "
            f"from weighed where {test}")


_SUMMARY = {  # shown texts, as in vigia.operators.evidence
    "text_obfuscation": "El texto usa técnicas para ocultar palabras sensibles.",
    "remote_access": "Pide instalar o usar una aplicación de acceso remoto.",
    "requests_security_code": "Pide compartir un código de seguridad o clave SMS.",
    "family_impersonation_emergency":
        "Patrón de estafa 'Hijo en apuros': simula ser un familiar con el teléfono roto pidiendo "
        "contactar por WhatsApp para un pago o emergencia económica.",
    "bank_from_mobile_number": "Dice ser un banco, pero llega desde un número móvil y pide actuar.",
    "urgency_language": "Usa prisa o amenaza de bloqueo para forzar una decisión.",
    "raw_ip_hostname": "El enlace usa una dirección IP en vez de un nombre de dominio.",
    "excessive_url_length": "El enlace es anormalmente largo y puede ocultar su destino.",
    "excessive_subdomains": "El enlace encadena demasiados subdominios para dificultar su lectura.",
    "deep_url_path": "El enlace tiene una ruta inusualmente profunda.",
    "phishing_url_keywords": "La ruta del enlace contiene palabras usadas para pedir acceso o datos.",
    "high_domain_entropy": "El dominio contiene una secuencia poco natural de caracteres.",
    "shortened_url": "El enlace está acortado y oculta el destino real.",
    "combo_squatting": "El dominio combina el nombre de la entidad con palabras añadidas.",
}
_say = lambda name: lit(_SUMMARY[name])
_known = "claimed_entity is not null"
EVIDENCE = {
    "flagged": f"""select *, regexp_matches(host, {lit(ctes._IPV4)}) as ip,
        len(string_split(host, '.')) as labels, {DEPTH} as depth, {_LABEL} as label,
        {ENTROPY} as ent, array_to_string(string_split(domain, '.')[-1:], '') as tld,
        len(list_filter(official_domains, lambda d: domain = d or domain like '%.' || d)) > 0 as official,
        list_max(list_transform(official_labels, lambda o: 1 - levenshtein(cand, o)::double /
          greatest(length(cand), length(o), 1))) as closest,
        len(list_filter(tokens, lambda t: length(t) >= 4 and contains(bare, t))) > 0 as embeds
        from (select *, {ctes.token("string_split(domain, '.')[1]")} as cand,
          {ctes.token('domain')} as bare from links)""",
    "weighed": f"""select r.*, {text_checks.OBFUSCATIONS} as obf, {text_checks.PERSONAL} as personal,
        case requested_action {' '.join(f"when '{a}' then {w}" for a, w in fixed.ACTION_WEIGHTS.items())}
          else 0 end as action_weight,
        (select count(*) from links l where l.message_id = r.message_id) as n_links,
        al.holder, al.holder_token, al.authorized, al.alias_token,
        coalesce(len(list_intersect(tokens, al.authorized)) > 0 or len(list_filter(tokens,
          lambda t: length(t) >= 4 and contains(al.holder_token, t))) > 0, false) as entitled,
        coalesce(regexp_replace(trim(sender), '[0-9\\s+().-]', '', 'g') <> '', false) as alphanumeric
        from read r left join (values {_ALIAS_ROWS}) al(alias_token, holder, holder_token, authorized)
          on al.alias_token = {ctes.token('r.sender')}""",
    "hits": " union all ".join([
        _text_hit("text_obfuscation", 15, "len(obf) > 0", _say("text_obfuscation"), 0),
        _text_hit("remote_access", 100, matches("detection", fixed.REMOTE_ACCESS), _say("remote_access"),
                  2, "true"),
        _text_hit("requests_security_code", 100,
                  f"requested_action = 'dar_codigo' and {matches('detection', fixed.SECURITY_CODE)} "
                  f"and not {matches('detection', fixed.CODE_WARNING)}", _say("requests_security_code"),
                  3, "true"),
        _text_hit("family_impersonation_emergency", 60,
                  " and ".join(matches("detection", p) for p in (
                      fixed.FAMILY, fixed.BROKEN_DEVICE, fixed.WHATSAPP))
                  + f" and (requested_action in ('transferir', 'introducir_credenciales') or "
                    f"{matches('detection', fixed.MONEY)})", _say("family_impersonation_emergency"), 4),
        _text_hit("personal_data_present", 0, "len(personal) > 0", "''", 7, telling="false"),
        _link_hit("raw_ip_hostname", 40, "ip", _say("raw_ip_hostname"), 0),
        _link_hit("excessive_url_length", 10, "length(url) >= 120", _say("excessive_url_length"), 2),
        _link_hit("excessive_subdomains", 10, "labels >= 5 and not ip", _say("excessive_subdomains"), 3),
        _link_hit("deep_url_path", 10, "depth >= 5", _say("deep_url_path"), 4),
        _link_hit("phishing_url_keywords", 10, matches(
            f"({ctes.path('url')} || {ctes.query('url')})", fixed.URL_KEYWORDS, "(?i)"),
            _say("phishing_url_keywords"), 5),
        _link_hit("high_domain_entropy", 20, "length(label) >= 14 and ent >= 3.7",
                  _say("high_domain_entropy"), 6),
        _link_hit("risky_tld", 35, f"tld in {ctes.any_of(fixed.RISKY_TLDS)}",
                  "'El enlace usa una terminación de dominio de alto riesgo: .' || tld || '.'", 7),
        _link_hit("shortened_url", 25, f"domain in {ctes.any_of(fixed.SHORTENERS)}",
                  _say("shortened_url"), 8),
        _link_hit("official_domain_match", 0, f"{_known} and official", "''", 9)
        .replace("true as telling", "false as telling"),
        _link_hit("claimed_entity_domain_mismatch", "case when closest >= 0.82 then 100 else 25 end",
                  f"{_known} and not official",
                  "case when closest >= 0.82 then 'El dominio imita al de ' || claimed_entity || "
                  "', pero no es oficial.' else 'El enlace no pertenece a un dominio oficial de ' || "
                  "claimed_entity || '.' end", 10, "closest >= 0.82"),
        _link_hit("combo_squatting", 35, f"{_known} and not official and embeds",
                  _say("combo_squatting"), 11),
        _text_hit("unverifiable_entity_claim", 15,
                  f"{_known} and n_links = 0 and requested_action <> 'ninguna'",
                  "'Dice ser ' || claimed_entity || ', pero no aporta un dominio que podamos verificar.'",
                  100000),
        _text_hit("bank_from_mobile_number", 65,
                  "category = 'bank' and requested_action <> 'ninguna' and regexp_matches(regexp_replace("
                  f"sender_number, '[^0-9]', '', 'g'), {lit(fixed.MOBILE_NUMBER)})",
                  _say("bank_from_mobile_number"), 100001),
        _text_hit("cnmc_alias_mismatch", 100,
                  f"alphanumeric and alias_token is not null and {_known} and not entitled",
                  "'Suplantación probada: el remitente ''' || sender || ''' está registrado en la CNMC a "
                  "nombre de ' || holder || ', no de ' || claimed_entity || '.'", 100002, "true"),
        _text_hit("cnmc_alias_verified", 0,
                  f"alphanumeric and alias_token is not null and not ({_known} and not entitled)",
                  "''", 100003, telling="false"),
        _text_hit("urgency_language", 15, "len(urgency_markers) > 0", _say("urgency_language"), 100004),
        _text_hit("requested_action", "action_weight", "action_weight > 0",
                  "'Solicita una acción sensible: ' || replace(requested_action, '_', ' ') || '.'", 100005),
        _text_hit("message_type_classifier", 0, "true", "''", 100006, telling="false"),
    ]),
    "shared": f"""select distinct message_id, domain from links where {' or '.join(
        f"domain = '{d}' or domain like '%.{d}'" for d in fixed.SHARED_INFRASTRUCTURE)}""",
    "calm": f"""select h.* from hits h left join shared s on s.message_id = h.message_id
        and s.domain = h.domain and h.check_name in {ctes.any_of(fixed.SUPPRESSIBLE)}
        where s.domain is null""",
}
_FAMILY = "case " + " ".join(
    f"when check_name = '{c}' then '{f}'" for c, f in fixed.FAMILY_OF_CHECK.items()
) + " else check_name end"


def decided(source: str) -> dict[str, str]:
    return {
        "families": f"""select message_id, {_FAMILY} as family, max(weight) as weight,
            bool_or(hard_rule) as hard_rule from {source} group by 1, 2""",
        "decided": """select *, case when hard_rule or score >= 70 then 'estafa'
              else 'no_puedo_confirmarlo' end as level,
            case when hard_rule then 0.99 when score >= 70 then greatest(0.7, score / 100)
              else least(0.69, greatest(0.2, score / 100)) end as confidence
            from (select message_id, least(100, sum(weight))::int as score, bool_or(hard_rule) as hard_rule
              from families group by message_id)""",
    }


LOCAL = {**EVIDENCE, **decided("hits")}
CALM = {**EVIDENCE, **decided("calm")}


def evidence_counts(spark, sf):
    rows = evidence.evidence_rows(read_messages(messages(spark, sf), WITH_ALIASES))
    return rows.where("status = 'hit'").groupBy("check_name").agg(
        F.count("*").alias("hits"), F.count_if("hard_rule").alias("hard_hits"),
        F.sum("weight").alias("weight"))


def verdicts(spark, sf):
    return scored(spark, sf).select(
        "message_id", "score", F.col("hard_rule").cast("int").alias("hard"), "level",
        F.round("confidence", 4).alias("confidence"))


def verdicts_by_language(spark, sf):
    return scored(spark, sf).groupBy("lang", "level").agg(
        F.count("*").alias("messages"), F.sum("score").alias("total_score"),
        F.count_if("hard_rule").alias("hard"))


def family_scores(spark, sf):
    return scored(spark, sf).select("message_id", F.explode("family_weights").alias("family", "weight")) \
        .groupBy("family").agg(F.count("*").alias("messages"), F.sum("weight").alias("weight"))


def top_reasons(spark, sf):
    return scored(spark, sf).select("message_id", F.array_join("reasons", "|").alias("reasons"))


def rule_traces(spark, sf):
    rows = judge(evidence.attach(
        read_messages(messages(spark, sf), WITH_ALIASES),
        intel.shared_platform_evidence(links_of(messages(spark, sf)))), WITH_ALIASES)
    return rows.select("message_id", F.explode("rule_trace").alias("r")).select(
        "message_id", "r.rule_id", "r.status", "r.observed", "r.threshold",
        F.array_join(F.array_sort("r.signal_names"), "|").alias("signals"),
        F.array_join(F.array_sort("r.suppressed_signal_names"), "|").alias("suppressed"))


_SORTED = "array_to_string(list_sort(list(distinct check_name)), '|')"
_TRACE = f"""
  select d.message_id, 'hard_evidence' as rule_id, case when d.hard_rule then 'fired' else 'not_fired' end as status,
    d.hard_rule::int as observed, 1 as threshold, coalesce(h.names, '') as signals, '' as suppressed
  from decided d left join (select message_id, {_SORTED} as names from calm where hard_rule group by 1) h
    using (message_id)
  union all
  select d.message_id, 'weighted_score', case when score >= 70 then 'fired' else 'not_fired' end, score, 70,
    coalesce(h.names, ''), '' from decided d left join (select message_id, {_SORTED} as names from calm
      where weight > 0 group by 1) h using (message_id)
  union all
  select d.message_id, 'shared_infrastructure_suppression', case when h.n > 0 then 'fired' else 'not_fired' end,
    coalesce(h.n, 0), 1, case when s.message_id is not null then 'shared_infrastructure_context' else '' end,
    coalesce(h.names, '')
  from decided d left join (select h.message_id, count(*)::int as n, {_SORTED} as names from hits h
      join shared s on s.message_id = h.message_id and s.domain = h.domain
        and h.check_name in {ctes.any_of(fixed.SUPPRESSIBLE)} group by 1) h using (message_id)
    left join (select distinct message_id from shared) s using (message_id)"""


def shared_suppression(spark, sf):
    rows = judge(evidence.attach(
        read_messages(messages(spark, sf), WITH_ALIASES),
        intel.shared_platform_evidence(links_of(messages(spark, sf)))), WITH_ALIASES)
    return rows.groupBy("level").agg(
        F.count("*").alias("messages"), F.sum("score").alias("score"),
        F.sum(F.size(F.filter("signals", lambda s: s["status"] == S.SUPPRESSED))).alias("suppressed"))


def stored_verdicts(spark, sf):
    """Verdicts recomputed from the long evidence table."""
    rows = evidence.evidence_rows(read_messages(messages(spark, sf), WITH_ALIASES))
    return scoring.verdict_from_rows(rows).select(
        "message_id", "score", F.col("hard_rule").cast("int").alias("hard"), "level")


def advice(spark, sf):
    return scored(spark, sf).groupBy("level", "requested_action", "message_type", "action").agg(
        F.count("*").alias("messages"), F.max(F.element_at("incident_steps", 1)).alias("first_step"))


def _advice_sql() -> str:
    do, steps = fixed.ADVICE_DO, fixed.ADVICE_STEPS
    return sql(f"""select level, requested_action, message_type,
      case when level = 'estafa' and requested_action in ('dar_codigo','introducir_credenciales','transferir')
          then {lit(do['secrets'])}
        when level = 'estafa' and requested_action = 'instalar_app' then {lit(do['install'])}
        when level = 'estafa' then {lit(do['scam'])} when message_type = 'spam' then {lit(do['spam'])}
        when message_type = 'transaccional' then {lit(do['delivery'])} else {lit(do['other'])} end as action,
      count(*) as messages,
      case when message_type = 'spam' then {lit(steps['spam'][0])}
        when message_type = 'transaccional' then {lit(steps['delivery'][0])}
        when requested_action = 'instalar_app' then {lit(steps['install'][0])}
        when requested_action in ('dar_codigo','introducir_credenciales') then {lit(steps['secrets'][0])}
        when requested_action = 'transferir' then {lit(steps['money'][0])}
        else {lit(steps['other'][0])} end as first_step
    from decided join typed using (message_id) group by all""", "links",
        extra={**LOCAL, **text_checks.TYPED})


# --- collected facts -----------------------------------------------------------------------------

def network_facts(spark, sf):
    """Registration, certificate and redirect facts derived from pages and events."""
    pages = table(spark, sf, "pages").join(
        events(spark, sf).select(F.col("event_id").alias("page_id"), "ts"), "page_id")
    from vigia.functions import urls as ur
    domains = pages.groupBy(ur.ascii_registrable(ur.host(F.col("url"))).alias("domain")).agg(
        F.max("ts").alias("cert_issued_at"), F.min("ts").alias("registered_at"))
    redirects = pages.select("url", (F.col("page_id") % 3).cast("int").alias("hops"),
                             F.when(F.col("page_id") % 2 == 0, "landing.example.org")
                             .otherwise("example.com").alias("final_domain"))
    linked = read_messages(messages(spark, sf))
    rows = evidence.network_evidence(linked, domains, redirects, NOW)
    return rows.select("message_id", "signal.*").groupBy("check_name", "status").agg(
        F.count("*").alias("n"), F.sum("weight").alias("weight"), F.count_if("hard_rule").alias("hard"))


_NETWORK = f"""
with_facts as materialized (select f.*, x.registered_at, x.cert_issued_at, x.domain is not null as has_dom,
    p.page_id is not null as has_red, p.page_id % 3 as hops,
    case when p.page_id % 2 = 0 then 'landing.example.org' else 'example.com' end as final_domain,
    regexp_matches(f.domain, {lit(ctes._IPV4)}) as ip
  from firsts f left join dom x on x.domain = f.domain left join pages p on p.url = f.url)
select check_name, status, count(*) as n, sum(weight)::bigint as weight, count_if(hard) as hard from (
  select 'domain_age' as check_name, case when hit then 'hit' when has_dom and not ip then 'miss'
      else 'not_applicable' end as status, case when hit then case when h then 100 else 45 end else 0 end as weight,
    hit and h as hard from (select *, coalesce(age < 30 and not ip, false) as hit,
      coalesce(claimed_entity is not null and age < 14, false) as h from (select *,
        floor((epoch({NOW_SQL}) - floor(epoch(registered_at))) / 86400) as age from with_facts))
  union all
  select 'tls_certificate_age', case when hit then 'hit' when has_dom and not ip then 'miss'
      else 'not_applicable' end, case when hit then 20 else 0 end, false from (select *,
      coalesce(floor((epoch({NOW_SQL}) - floor(epoch(cert_issued_at))) / 86400) < 7 and not ip, false) as hit
      from with_facts)
  union all
  select 'redirect_chain', case when hit then 'hit' when has_red then 'miss' else 'not_applicable' end,
    case when hit then 20 else 0 end, false from (select *, coalesce(has_red and hops > 0
      and final_domain <> domain and not coalesce(len(list_filter(official_domains,
        lambda d: final_domain = d or final_domain like '%.' || d)) > 0, false), false) as hit from with_facts)
) group by 1, 2"""
_FIRSTS = {
    "firsts": """select * from (select *, row_number() over (partition by message_id order by position) as k
        from (select *, row_number() over (partition by message_id, domain order by position) as again
          from links) where again = 1)""",
    "dom": f"""select {ctes.registrable(ctes.host('url'))} as domain, max(ts) as cert_issued_at,
        min(ts) as registered_at from pages join events on event_id = page_id group by 1""",
}


def page_scans(spark, sf):
    """Form fields of every page. The given pages have few, so some get the forms a clone would."""
    pages = table(spark, sf, "pages").withColumn("html", F.concat(
        "html", F.when(F.col("page_id") % 6 == 0, '<form><INPUT class="x" type="password"><input name=user>')
        .when(F.col("page_id") % 6 == 1, "<input autocomplete='cc-number'><input type=text name='myCardNo'>")
        .when(F.col("page_id") % 6 == 2, '<input name="tarjeta"><input type=password><input type="text">')
        .otherwise("<input type='checkbox' name=agree>")))
    return evidence.page_scan(pages).select("page_id", "password_fields", "payment_fields")


_SCAN = r"""select page_id,
  (len(regexp_extract_all(html, '(?i)<input\b[^>]*\stype\s*=\s*["'']?password\b'))
    + case when page_id % 6 in (0, 2) then 1 else 0 end)::int as password_fields,
  (len(list_filter(regexp_extract_all(html, '(?i)<input\b[^>]*>'), lambda i: regexp_matches(i,
      '(?i)autocomplete\s*=\s*["'']?cc-|name\s*=\s*["'']?[^"''\s>]*(card|tarjeta)')))
    + case page_id % 6 when 1 then 2 when 2 then 1 else 0 end)::int as payment_fields from pages"""


def page_evidence(spark, sf):
    pages = evidence.page_scan(table(spark, sf, "pages")).select(
        "url", F.lit("landing.example.org").alias("final_domain"),
        ((F.col("page_id") % 4 == 0).cast("int")).alias("password_fields"), "payment_fields",
        (F.col("page_id") % 5 == 0).alias("download_attempted"),
        F.when(F.col("page_id") % 9 == 0, "BBVA").alias("visual_clone_entity"),
        (F.col("page_id") % 100 / 100.0).alias("visual_similarity"))
    linked = extract.link_structs(messages(spark, sf).select(
        "message_id", F.array(F.regexp_extract("body", r"(\S+)$", 1)).alias("urls")))
    return evidence.page_evidence(linked, pages).select("message_id", "signal.*").groupBy(
        "check_name", "status").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"),
                                    F.count_if("hard_rule").alias("hard"))


_PAGE_EVIDENCE = f"""with m as (select p.*, {ctes.registrable(ctes.host('p.url'))} as domain
    from messages join pages p on p.page_id = doc_id % (select count(*) from pages))
  select check_name, case when hit then 'hit' else 'miss' end as status, count(*) as n,
    sum(case when hit then w else 0 end)::bigint as weight, count_if(hit and h) as hard from (
    select 'browser_credential_form' as check_name, page_id % 4 = 0 as hit, 50 as w, false as h from m
    union all select 'browser_download_attempt', page_id % 5 = 0, 60, false from m
    union all select 'browser_cross_domain_navigation', domain <> 'landing.example.org', 20, false from m
    union all select 'visual_brand_clone', true, 100, true from m
      where page_id % 9 = 0 and page_id % 100 >= 85) group by 1, 2"""


def hash_list(spark, sf):
    """Full digests of every third page address as the published list."""
    from vigia.functions import urls as ur
    listed = table(spark, sf, "pages").where("page_id % 3 = 0").select(
        F.sha2(ur.canonical_url(F.col("url")), 256).alias("url_hash"),
        F.array(F.lit("SOCIAL_ENGINEERING")).alias("threat_types"))
    return evidence.hash_list_evidence(links_of(messages(spark, sf)), listed).select(
        "message_id", "signal.check_name", "signal.weight")


QUERIES = {
    "verdicts_by_language": (verdicts_by_language, sql(
        "select lang, level, count(*) as messages, sum(score)::bigint as total_score, "
        "count_if(hard_rule) as hard from decided join messages using (message_id) group by 1, 2",
        "links", extra=LOCAL)),
    "url_facts": (url_facts, sql(_LINK_SQL, "raw_links", "foreign_pages", extra={"all_links": _ALL_LINKS})),
    "brand_match": (brand_match, sql(_brand_sql(), "brands")),
    "evidence_counts": (evidence_counts, sql(
        "select check_name, count(*) as hits, count_if(hard_rule) as hard_hits, "
        "sum(weight)::bigint as weight from hits group by 1", "links", extra=EVIDENCE)),
    "verdicts": (verdicts, sql(
        "select message_id, score, hard_rule::int as hard, level, round(confidence, 4)::double as confidence "
        "from decided", "links", extra=LOCAL)),
    "family_scores": (family_scores, sql(
        "select family, count(*) as messages, sum(weight)::bigint as weight from families group by 1",
        "links", extra=LOCAL)),
    "top_reasons": (top_reasons, sql(
        f"""select message_id, coalesce(array_to_string(r.reasons[1:3], '|'), {lit(fixed.DEFAULT_REASON)}) as reasons
          from messages left join (select message_id, list(summary order by hard_rule desc, weight desc, ordinal) as reasons
            from (select message_id, summary, first(hard_rule order by hard_rule desc, weight desc, ordinal) as hard_rule,
              first(weight order by hard_rule desc, weight desc, ordinal) as weight,
              first(ordinal order by hard_rule desc, weight desc, ordinal) as ordinal
              from hits where telling group by 1, 2) group by 1) r using (message_id)""",
        "links", extra=EVIDENCE)),
    "rule_traces": (rule_traces, sql(_TRACE, "links", extra=CALM)),
    "shared_suppression": (shared_suppression, sql(
        """select level, count(*) as messages, sum(score)::bigint as score, sum(coalesce(n, 0))::bigint as suppressed
          from decided left join (select message_id, (count(*) filter (check_name not like 'x%')) as n from (
            select * from hits except all select * from calm) group by 1) using (message_id) group by 1""",
        "links", extra=CALM)),
    "stored_verdicts": (stored_verdicts, sql(
        "select message_id, score, hard_rule::int as hard, level from decided", "links", extra=LOCAL)),
    "advice": (advice, _advice_sql()),
    "network_facts": (network_facts, sql(
        _NETWORK[_NETWORK.index("select check_name"):], "links", extra={
            **_FIRSTS, "with_facts": _NETWORK[_NETWORK.index("(") + 1:_NETWORK.index(")\nselect check_name")]})),
    "page_scans": (page_scans, _SCAN),
    "page_evidence": (page_evidence, sql(
        _PAGE_EVIDENCE[_PAGE_EVIDENCE.index("select check_name"):], "messages", extra={
            "m": _PAGE_EVIDENCE[len("with m as ("):_PAGE_EVIDENCE.index(")\n  select check_name")]})),
    "hash_list": (hash_list, sql(
        "select distinct message_id, sha256(canonical_url) as h, "
        "'google_safe_browsing_hash_match' as check_name, 60 as weight from links where sha256(canonical_url) in "
        f"(select sha256({ctes.canonical('url')}) from pages where page_id % 3 = 0)", "links")
        .replace("select distinct message_id, sha256(canonical_url) as h, ", "select distinct message_id, ")),
}
