import hashlib
import random
import re

from pyspark.sql import functions as F

from vigia.functions import hashing, pii, text as tx, urls as ur


def values(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", build(F.col("t")).alias("x")).orderBy("i").collect()]


def test_detection_view_sees_through_tricks(spark):
    given = ["c​ó​digo SMS", "c o d i g o SMS de confirmacion", "c0d1go", "4nyD3sk", "1ogin",
             "instala Any Desk ahora", "sаntander login", "ﬁn… Straße", "y o tengo 2 b c"]
    assert values(spark, given, tx.detection_view) == [
        "codigo sms", "codigo sms de confirmacion", "codigo", "anydesk", "iogin",
        "instala anydesk ahora", "santander login", "fin... strasse", "y o tengo 2 b c"]


def test_obfuscation_labels(spark):
    labels = values(spark, ["c​ódigo", "sаntander", "A n y D e s k", "Any Desk", "4nyD3sk",
                            "Texto normal sin trucos"], tx.obfuscations)
    assert [len(x) for x in labels] == [1, 1, 1, 1, 1, 0]


def test_redaction(spark):
    text = ("DNI 12345678Z, IBAN ES91 2100 0418 4502 0005 1332, teléfono +34 612 345 678 y correo "
            "persona@example.com")
    once, link, code, calm = values(spark, [
        text, "https://example.org/login?token=secret&lang=es#private", "Tu código SMS es 123456",
        "Verifica tus datos en 24 horas en https://example.org/acceso"], pii.redact)
    assert once == "DNI [DNI], IBAN [IBAN], teléfono [TELÉFONO] y correo [EMAIL]"
    assert link == "https://example.org/login?token=%5BDATO%5D&lang=es"
    assert code == "Tu [CÓDIGO]"
    assert calm.startswith("Verifica tus datos en 24 horas")
    assert values(spark, [once, code], pii.redact) == [once, code]  # idempotent


def test_iban_and_card_checks(spark):
    assert values(spark, ["ES91 2100 0418 4502 0005 1332", "ES91 2100 0418 4502 0005 1333"],
                  pii.valid_iban) == [True, False]
    assert values(spark, ["4111 1111 1111 1111", "4111 1111 1111 1112"], pii.valid_card) == [True, False]


def test_json_redaction_keeps_keys_and_quotes(spark):
    assert values(spark, ['{"email":"a@b.es","n":[1,"say \\"hi\\" 12345678Z"]}'], pii.redact_json) == [
        '{"email":"[EMAIL]","n":[1,"say \\"hi\\" [DNI]"]}']


def test_domains(spark):
    given = ["https://login.example.co.uk/access", "https://sub.example.com/path", "https://192.0.2.10/path"]
    assert values(spark, given, lambda u: ur.registrable(ur.host(u))) == [
        "example.co.uk", "example.com", "192.0.2.10"]
    assert values(spark, ["EXAMPLE.ORG", "2026.08.18", "bad_label.example"], ur.normal_domain) == [
        "example.org", None, None]
    assert values(spark, ["www.Foo.com:443/a/12345/deadbeef99?b=1&A=2&c=#x"],
                  lambda u: ur.path_template(u, ur.registrable(ur.host(u)))) == [
        "foo.com/a/{token}/{token}?a&b"]


def test_international_host_is_compared_decoded(spark):
    df = spark.createDataFrame([(["sаntander.com", "plain.es", "a..b"],)], "h array<string>")
    ids = df.select(ur.idna_hosts(F.col("h")).alias("x")).first()["x"]
    assert ids[0]["ascii"].startswith("xn--") and ids[1]["ascii"] == "plain.es" and ids[2]["ascii"] is None


def test_simhash_packed_equals_bit_by_bit(spark):
    import hashlib
    import re
    texts = ["hola mundo hola", "paga 25 en https://a.es ahora", "", "uno dos tres cuatro cinco seis"]

    def plain(text):
        words = re.findall(r"[a-z]{2,}|URL|N", re.sub(r"\d+", " N ", re.sub(r"https?://\S+", " URL ", text)))
        if not words:
            return 0
        sums = [0] * 64
        for w in words:
            h = int(hashlib.md5(w.encode()).hexdigest()[:16], 16)
            for b in range(64):
                sums[b] += 1 if h >> b & 1 else -1
        value = sum(1 << b for b in range(64) if sums[b] >= 0)
        return value - (1 << 64) if value >= 1 << 63 else value

    assert values(spark, texts, tx.simhash) == [plain(t) for t in texts]


def test_keyed_hash_and_uuid5(spark):
    import hashlib
    import hmac
    import uuid
    assert values(spark, ["abc", None], lambda c: hashing.hmac_sha256(c, b"k" * 80)) == [
        hmac.new(b"k" * 80, b"abc", hashlib.sha256).hexdigest(), None]
    assert values(spark, ["x:y"], lambda c: hashing.uuid5(uuid.NAMESPACE_URL, c)) == [
        str(uuid.uuid5(uuid.NAMESPACE_URL, "x:y"))]


def test_suffix_rules_longest_wins_in_plan_and_join(spark):
    """Normal, wildcard, exception, private and international rules; the plan's literal and the join agree."""
    from vigia.functions import suffixes as sx
    lines = ["// comment", "", "com", "uk", "co.uk", "jp", "kawasaki.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck",
             "github.io", "io", "рф", "CO.Nz  trailing words"]
    hosts = {"a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "x.city.kawasaki.jp": "city.kawasaki.jp", "y.x.foo.kawasaki.jp": "x.foo.kawasaki.jp",
             "foo.kawasaki.jp": "foo.kawasaki.jp", "www.ck": "www.ck", "a.www.ck": "www.ck", "a.b.ck": "a.b.ck", "b.ck": "b.ck", "ck": "ck",
             "a.b.unknown": "a.b.unknown", "10.0.0.1": "10.0.0.1", "u.github.io": "u.github.io", "v.u.github.io": "u.github.io",
             "a.xn--80abxggjd.xn--p1ai": "xn--80abxggjd.xn--p1ai", "x.co.nz": "x.co.nz", "com": "com", "": "", None: None}
    df = spark.createDataFrame([(h, 1) for h in hosts], "h string, name int").repartition(3)
    rules = sx.parse_rules(lines)
    got = {r["h"]: r["d"] for r in df.select("h", ur.registrable(F.col("h"), rules).alias("d")).collect()}
    assert got == hosts
    table = sx.rules_table(spark.createDataFrame([(x,) for x in lines], "value string"))
    joined = sx.with_registrable(df, "h", "d", table)
    assert joined.columns == ["h", "name", "d"] and {r["h"]: r["d"] for r in joined.collect()} == hosts


def test_international_names_reach_their_ascii_form(spark):
    given = ["http://u:p@Bücher.example:8080/x", "straße.de", "日本語。jp", "a..b", "x" * 64 + ".com", " \".МОЙБАНК.РФ.\" ", "bad_label.com", None]
    assert values(spark, given, ur.normal_domain) == [
        "xn--bcher-kva.example", "strasse.de", "xn--wgv71a119e.jp", None, None, "xn--80abxggjd.xn--p1ai", None, None]
    urls = ["https://u:p@bücher.de:8443/a?b#c", "http://straße.de:80", "https://x.de:99999/", "ftp://x.de/"]
    assert values(spark, urls, ur.canonical_url) == ["https://xn--bcher-kva.de:8443/a?b", "http://strasse.de/", None, None]


def test_spaced_letters_of_any_width_and_number(spark):
    given = ["c  o\t" + " " * 200 + "d i g o SMS", "x " + "a " * 30_000 + "fin", "s i", "una d e f", "d e f9", "c o\u2003d i\u00a0go"]
    assert values(spark, given, tx.detection_view) == ["codigo sms", "x" + "a" * 30_000 + " fin", "s i", "una def", "d e f9", "codi go"]
    labels = values(spark, given, lambda t: F.size(tx.obfuscations(t)))
    assert labels == [1, 1, 0, 1, 0, 1], labels


def test_simhash_counts_bits_without_lambdas(spark):
    """Majority of every bit by hand, with texts longer than one part of the bits and rows without words."""
    rng = random.Random(3)
    texts = [None, "", "12 !", "aa bb", "aa bb bb", " ".join("ab" * rng.randint(1, 9) + rng.choice("xyz") for _ in range(70_000))]
    texts += [" ".join("".join(rng.choices("abcde", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 60))) for _ in range(30)]

    def by_hand(text):
        hashes = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in re.findall("[a-z]{2,}|URL|N", re.sub(r"\d+", " N ", text or ""))]
        print_ = sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) >= len(hashes))
        return print_ - (1 << 64) if print_ >> 63 else print_

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.simhash(F.col("t")).alias("s"))
    assert {r["i"]: r["s"] for r in rows.collect()} == {i: by_hand(t) for i, t in enumerate(texts)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan  # an interpreted lambda: once a word and pass


def test_text_tests_pick_the_same_words_as_their_plain_forms(spark):
    """The shorter tests in front of spaced letters, leet words and blanks lose no text and add none."""
    given = ["a\x1cb\x1cc", "x a b c y", "éa b c", "a b c.", "a b cd", "a  b\tc", "дa-c0digo", "c0digo-д b4nco",
             "-c0digo-", "4", "a_4", "é4", "4é", "a23b", "b4nc0\U0001f600 c0digo", "lİquid cſ0", "­а", "",
             "1\n2\x85\n3", "-" * 5000 + "4a", "y él a à ver", "a b cñ", "n0 h4y_clave 1bum c1ave"]
    plain = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    leet = r"[013457][0-9]*[A-Za-z_-]|[A-Za-z_-][0-9]*[013457]"
    rows = plain.select(
        "t", tx._leet_tokens(F.col("t")).alias("ours"), F.col("t").rlike(leet).alias("leet"),
        F.col("t").rlike(tx._LEET_TOKEN).alias("quick"), tx.obfuscations(F.col("t")).alias("labels"),
        F.regexp_replace(tx.fold(F.col("t"), "token"), tx._BLANKS, " ").alias("blanks"),
        tx.one_blank(tx.fold(F.col("t"), "token")).alias("ascii_blanks"),
        F.array_join(F.transform(F.split("t", tx._TOKEN_EDGE), lambda w: F.when(
            w.rlike("^[A-Za-z0-9_-]*[A-Za-z][A-Za-z0-9_-]*$"), F.translate(w, "013457", "oieast")).otherwise(w)), "")
        .alias("split")).collect()
    for row in rows:
        assert row.quick == row.leet, row
        assert row.ours == (row.split if row.leet else row.t), row
        if not any(c in row.t for c in "\x85   "):
            assert row.ascii_blanks == row.blanks, row
    assert [row.labels for row in rows if "c0digo" in row.t] == [[tx.fixed.OBFUSCATION_LABELS[4]]] * 4


def test_word_patterns_behind_a_word_start_find_the_same(spark):
    from vigia import fixed
    from vigia.dims import alias_forms, default_brands
    from vigia.operators.extract import _java_quote, claimed_brand

    chance = random.Random(11)
    patterns = [p for _, p in fixed.ACTIONS + fixed.COMMERCIAL] + [
        fixed.MONEY, fixed.FAMILY, fixed.SECURITY_CODE, fixed.PERSONAL, fixed.TRANSACTIONAL]
    forms = alias_forms(default_brands())
    words = [w for p in patterns for w in re.split(r"[|()\[\]?:\\{}*+.]", p) if w.strip()]
    words += [a for a, _ in forms] + ["é", "٢", "_", "😀", "50 €", "mi€", "ſ", "DE89370400440532013000", "no15 9386 0111 7947"]
    texts = ["".join(chance.choice(words) + chance.choice([" ", " ", "", "-", "é", ".", "_", "😀", "  "])
                     for _ in range(chance.randint(1, 7))) for _ in range(400)] + ["", None]
    texts += [t.upper() for t in texts[:100]]
    plain = r"(?U)(?<!\w)(?=(" + "|".join(_java_quote(a) for a, _ in forms) + r")(?!\w))"
    owner = dict(forms)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", claimed_brand(F.col("t"), default_brands()).alias("brand"),
        F.regexp_extract_all("t", F.lit(plain), F.lit(1)).alias("aliases"),
        pii.sensitive_types(F.col("t")).alias("kinds"),
        F.exists(pii._all(F.col("t"), pii._IBAN), pii.valid_iban).alias("iban"),
        F.array(*[tx.says(F.col("t"), p, f) for p in patterns for f in ("(?U)", "(?iU)")]).alias("ours"),
        F.array(*[F.col("t").rlike(f + p) for p in patterns for f in ("(?U)", "(?iU)")]).alias("theirs")).collect()
    assert any(r.iban for r in rows) and sum(any(r.ours) for r in rows) > 100
    for r in rows:
        assert r.ours == r.theirs, r.t
        if r.t is not None:
            best = max(r.aliases, key=lambda a: (len(a), -owner[a]), default=None)
            assert r.brand == (None if best is None else owner[best]), r.t
            assert ("iban" in r.kinds) == r.iban, r.t


def test_texts_of_a_corpus_are_redacted_once(spark):
    from vigia.operators import corpus

    sms = spark.createDataFrame([("ver https://a.es/x", "spam", 1), ("  ", "ham", 2), ("VER https://b.es/y", "ham", 3)],
                                "texto string, etiqueta string, n int")
    rows = corpus.training_rows(sms, "sms", "n")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("[ENLACE]") == 1
    assert [(r.text, r.label) for r in rows.collect()] == [("ver [ENLACE]", "spam")]
