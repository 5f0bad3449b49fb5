"""Hosts, domains and links as Column expressions.

International host names take their IDNA form on the JVM; nothing here needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigia import fixed
from vigia.functions import pii
from vigia.functions.suffixes import MAX_INLINE, SuffixRules, default_rules, to_ascii, to_shown
from vigia.functions.text import let, token

_IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
_IPV6 = r"^[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7}(?:\.[0-9.]+)?$"


def extract_urls(text: Column) -> Column:
    """Links in order of appearance, without closing punctuation, each once."""
    found = F.regexp_extract_all(text, F.lit(pii.URL), F.lit(0))
    return F.array_distinct(
        F.transform(found, lambda u: F.rtrim(u, F.lit(fixed.URL_TRAILING))))


def _absolute(url: Column) -> Column:
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))


def _authority(url: Column) -> Column:
    netloc = F.regexp_extract(_absolute(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_extract(netloc, r"([^@]*)$", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_absolute(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def host(url: Column) -> Column:
    """Lower-case host name without port and closing dots; null when there is none."""
    def name(authority: Column) -> Column:
        return F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)) \
            .otherwise(F.regexp_extract(authority, r"^([^:]*)", 1))

    bare = F.rtrim(F.lower(let(_authority(url), name)), F.lit("."))
    return let(bare, lambda n: F.when(n != "", n))


def port(url: Column) -> Column:
    return F.regexp_extract(_authority(url), r":([^:\]]*)$", 1)


def is_ip(name: Column) -> Column:
    return name.rlike(_IPV4) | name.rlike(_IPV6)


def idna_hosts(names: Column) -> Column:
    """array<host> -> array<struct<ascii, shown>>; ascii is null for a host that is not valid."""
    return F.transform(names, lambda n: let(to_ascii(n), lambda a: F.struct(
        a.alias("ascii"), F.coalesce(to_shown(a), n).alias("shown"))))


def registrable(host_name: Column, rules: SuffixRules | None = None) -> Column:
    """Longest known suffix plus one label, in the spelling of the host; addresses, bare suffixes and hosts
    without a known suffix stay as they are."""
    known = rules or default_rules()
    if known.size > MAX_INLINE:
        raise ValueError("too many suffix rules for a plan: use suffixes.with_registrable")

    def cut(name: Column) -> Column:
        unknown = 1 if known.any_last_label else 0
        size = F.when(is_ip(name), 0).otherwise(F.greatest(known.suffix_labels(name), F.lit(unknown)))
        return let(size, lambda n: F.when((n == 0) | (n >= F.size(F.split(name, r"\."))), name).otherwise(
            F.call_function("substring_index", name, F.lit("."), -(n + 1))))

    return F.when(host_name.isNotNull(), let(host_name, cut))


def ascii_registrable(name: Column) -> Column:
    """Registrable domain of a stored host or feed value in ASCII; null for a name that is not valid."""
    return registrable(to_ascii(name))


def normal_domain(value: Column) -> Column:
    """Feed value as a domain in ASCII, or null: labels of at most 63 letters, digits and inner hyphens, the last
    not a number; international names in their IDNA form."""
    shape = r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$"

    def check(name: Column) -> Column:
        return F.when(name.rlike(shape) & ~name.rlike(r"\.[0-9]+$"), name)

    bare = let(F.lower(F.btrim(F.trim(value), F.lit('."'))),
               lambda v: F.when(v.contains("://"), host(v)).otherwise(v))
    return let(let(bare, to_ascii), check)


def canonical_url(url: Column) -> Column:
    """Absolute http(s) link without user data, usual ports and fragment; null when not one."""
    def build(link: Column) -> Column:
        name, given, path, query = link["name"], link["port"], link["path"], link["query"]
        shown = F.when(given.isin("", "80", "443"), F.lit("")).otherwise(
            F.concat(F.lit(":"), F.regexp_replace(given, "^0+(?=.)", "")))
        valid = (
            link["scheme"].isin("http", "https") & name.isNotNull() & given.rlike("^[0-9]{0,5}$")
            & (F.coalesce(F.try_to_number(given, F.lit("99999")), F.lit(0)) <= 65535)
        )
        return F.when(valid, F.concat(
            link["scheme"], F.lit("://"), name, shown,
            F.when(path == "", F.lit("/")).otherwise(path),
            F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
        ))

    return let(F.struct(
        F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).alias("scheme"),
        normal_domain(host(url)).alias("name"), port(url).alias("port"),
        path_of(url).alias("path"), query_of(url).alias("query"),
    ), build)


def suffix_candidates(domain: Column) -> Column:
    """a.b.c -> [a.b.c, b.c]: every parent with at least two labels."""
    labels = F.split(domain, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


_TOKEN_SEGMENT = r"^(?:[0-9]{4,}|[0-9a-fA-F]{8,}|[A-Za-z0-9_-]{20,})$"


def path_template(url: Column, domain: Column) -> Column:
    """Domain, path with variable segments masked and the sorted names of the query keys."""
    authority_users = F.regexp_extract(_absolute(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)@", 1)
    scheme = F.lower(F.regexp_extract(_absolute(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    allowed = (
        scheme.isin("http", "https") & domain.isNotNull() & authority_users.isin("", ":")
        & port(url).isin("", "80", "443")
    )
    path = F.array_join(
        F.transform(F.split(path_of(url), "/"), lambda part: F.when(
            part.rlike(_TOKEN_SEGMENT), F.lit("{token}")).otherwise(F.lower(part))), "/")
    pairs = F.filter(
        F.split(query_of(url), "&"), lambda p: p.rlike("=.") )
    keys = F.array_sort(F.array_distinct(F.transform(
        pairs, lambda p: F.lower(pii._form_decode(F.substring_index(p, "=", 1))))))
    shape = F.array_join(keys, "&")
    return F.when(allowed, F.concat(
        domain, F.when(path == "", F.lit("/")).otherwise(path),
        F.when(shape == "", F.lit("")).otherwise(F.concat(F.lit("?"), shape)),
    ))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character."""
    def bits(text: Column) -> Column:
        total = F.char_length(text).cast("double")
        chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
        shares = F.transform(
            chars, lambda c: (total - F.char_length(F.replace(text, c, F.lit("")))) / total)
        return F.aggregate(shares, F.lit(0.0), lambda sum_, s: sum_ - s * F.log2(s))

    return let(value, bits)


def longest_label(name: Column) -> Column:
    """First of the longest labels."""
    return F.aggregate(
        F.split(name, r"\."), F.lit(""),
        lambda best, label: F.when(
            F.char_length(label) > F.char_length(best), label).otherwise(best))


def label_similarity(shown_domain: Column, official_label: Column) -> Column:
    """Closeness of the first label (international labels already decoded) to an official one."""
    return token_similarity(token(F.substring_index(shown_domain, ".", 1)), official_label)


def token_similarity(candidate: Column, official: Column) -> Column:
    size = F.greatest(F.char_length(candidate), F.char_length(official), F.lit(1))
    return F.lit(1.0) - F.levenshtein(candidate, official) / size


def valid_hostname(value: Column) -> Column:
    bare = F.ltrim(F.trim(value), F.lit("*."))
    return ~bare.rlike("[ ,/]") & bare.contains(".")


def under(domain: Column, parents: tuple[str, ...]) -> Column:
    """Domain equals one of the parents or lies below it."""
    return F.exists(suffix_candidates(domain), lambda d: d.isin(*parents)) | domain.isin(*parents)
