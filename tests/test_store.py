import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigia import schemas as S
from vigia.functions import urls
from vigia.operators import campaigns, evidence, extract, hunt, intel, upkeep

NOW = datetime(2026, 8, 20, 12)


def indicators(spark, rows):
    return spark.createDataFrame(rows, S.INDICATORS)


def snapshot(spark, provider, age_hours):
    return spark.createDataFrame([(f"{provider}-1", provider, "v", "", 1, NOW - timedelta(hours=age_hours),
                                   True, None)], S.SNAPSHOTS)


def one_link(spark):
    return spark.createDataFrame([("m", "bad.example", "bad.example", None)],
                                 "message_id string, domain string, host string, canonical_url string")


def listed(spark, provider):
    return indicators(spark, [(provider, f"{provider}-1", "domain", "h", "bad.example", "active", NOW, NOW)])


def test_fresh_and_stale_matches(spark):
    for age, name, weight in ((0, "known_bad_indicator", 60), (48, "stale_threat_indicator", 0)):
        got = intel.reputation_evidence(one_link(spark), listed(spark, "destroylist"),
                                        snapshot(spark, "destroylist", age), NOW).collect()
        assert [(r["signal"]["check_name"], r["signal"]["weight"]) for r in got] == [(name, weight)]


def test_merge_keeps_first_seen_and_inactivates(spark):
    old = NOW - timedelta(days=3)
    stored = indicators(spark, [("p", "s0", "domain", "a", "a.es", "active", old, old),
                                ("p", "s0", "domain", "b", "b.es", "active", old, old)])
    incoming = spark.createDataFrame([("p", "domain", "a", "a.es"), ("p", "domain", "c", "c.es")],
                                     "provider string, indicator_type string, value_hash string, value_public string")
    sync = spark.createDataFrame([("p", "s1", NOW)], "provider string, snapshot_id string, fetched_at timestamp")
    got = {r["value_hash"]: r for r in intel.merge_snapshot(stored, incoming, sync).collect()}
    assert got["a"]["first_seen"] == old and got["a"]["last_seen"] == NOW and got["a"]["status"] == "active"
    assert got["b"]["status"] == "inactive" and got["b"]["last_seen"] == old
    assert got["c"]["first_seen"] == NOW


def brute_shared(wanted, held, k):
    found = {}
    for m, t, v in wanted:
        for c, t2, v2 in held:
            if (t, v) == (t2, v2):
                found.setdefault((m, c), set()).add(t)
    return {p: sorted(ts) for p, ts in found.items() if len(ts) >= k}


def test_shared_campaigns_equals_brute_force_on_skew(spark):
    import random
    rng = random.Random(7)
    kinds = ["domain", "phone", "iban", "url_path_template"]
    side = lambda n, tag: [(f"{tag}{i}", k, "hot" if k == "domain" or rng.random() < .3 else str(rng.randrange(6)))
                           for i in range(n) for k in rng.sample(kinds, 3)]
    wanted, held = side(40, "m"), side(15, "c")
    for k in (1, 2, 3):
        got = campaigns.shared_campaigns(
            spark.createDataFrame(wanted, "message_id string, artifact_type string, value_hash string"),
            spark.createDataFrame(held, "campaign_id string, artifact_type string, value_hash string"), k).collect()
        assert {(r[0], r[1]): r[2] for r in got} == brute_shared(wanted, held, k)


def test_text_match_equals_brute_force(spark):
    import random
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(64), n))
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    camps = [(f"c{i}", signed(flip(base[i % 6], rng.randrange(4)))) for i in range(12)]
    msgs = [(f"m{i}", signed(flip(base[i % 6], rng.randrange(8)))) for i in range(60)]
    known = spark.createDataFrame([(c, f, NOW, NOW, 1, None, S.LEVEL_SCAM, False, "simhash") for c, f in camps],
                                  S.CAMPAIGNS)
    got = {r["message_id"]: r["campaign_id"] for r in campaigns.match_texts(
        spark.createDataFrame(msgs, "message_id string, simhash bigint"), known, NOW).collect()}
    want = {}
    mask = (1 << 64) - 1
    for m, f in msgs:
        best = [(bin((f ^ g) & mask).count("1"), c) for c, g in camps
                if any(((f ^ g) >> s) & 65535 == 0 for s in (0, 16, 32, 48))]
        best = [b for b in best if b[0] <= 6]
        if best:
            want[m] = min(best)[1]
    assert got == want


def test_all_artifacts_of_a_long_message_are_built(spark):
    body = " ".join(f"https://site{k}.example/a/{k}" for k in range(90)) + " " + " ".join(
        f"+346001{k:05d}" for k in range(25))
    df = spark.createDataFrame([("m", body, None)], "message_id string, body string, sender_number string")
    linked = extract.link_structs(df.withColumn("urls", urls.extract_urls(F.col("body"))))
    found = [(r["artifact_type"], r["value_public"]) for r in campaigns.build_artifacts(linked, b"k").collect()]
    assert {v for t, v in found if t == "domain"} == {f"site{k}.example" for k in range(90)}
    assert sum(t == "phone" for t, _ in found) == 25


def test_pages_behind_later_links_are_seen(spark):
    df = spark.createDataFrame([("m", ["https://ok.example/", "https://bad.example/in", "https://bad.example/in"]),
                                ("n", ["https://ok.example/"]), ("none", [])], "message_id string, urls array<string>")
    scans = spark.createDataFrame(
        [("https://ok.example/", "ok.example", 0, 0, False, None, None),
         ("https://bad.example/in", "other.example", 1, 0, True, "BBVA", 0.9)],
        "url string, final_domain string, password_fields int, payment_fields int, download_attempted boolean, "
        "visual_clone_entity string, visual_similarity double")
    rows = evidence.page_evidence(extract.link_structs(df), scans).select("message_id", "ordinal", "signal.*").collect()
    hits = sorted((r["message_id"], r["check_name"]) for r in rows if r["status"] == "hit")
    assert hits == [("m", name) for name in ("browser_credential_form", "browser_cross_domain_navigation",
                                             "browser_download_attempt", "visual_brand_clone")]
    assert len({(r["message_id"], r["ordinal"]) for r in rows}) == len(rows) == 3 + 3 + 4


def test_checksum_gathers_nothing_in_one_row(spark):
    values = [f"http://h{k % 700}.example/é" for k in range(2000)] + [None, "z", "Z", "😀", "\uffee"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = intel.sorted_values_checksum(df)
    kinds = sorted({v for v in values if v is not None}, key=str.encode)
    assert tuple(got.first()) == (hashlib.sha256("".join(kinds).encode()).hexdigest(), len(kinds))
    assert "collect_set" not in got._jdf.queryExecution().toString()
    assert intel.sorted_values_checksum(df.limit(0)).first()["checksum"] == hashlib.sha256(b"").hexdigest()


def test_enqueue_is_idempotent(spark):
    found = spark.createDataFrame([("m", "new_threat_indicator", "a.es", {"domain": "a.es"})] * 2,
                                  "message_id string, reason string, reference string, payload map<string,string>")
    empty = spark.createDataFrame([], S.REVIEWS)
    first = hunt.enqueue(found, empty, NOW)
    assert first.count() == 1 and hunt.enqueue(found, first, NOW).count() == 0


def test_purge_is_idempotent_and_keeps_rows(spark):
    rows = spark.createDataFrame([("old", "api", "h", NOW - timedelta(days=2), "text", "es", None),
                                  ("new", "api", "h", NOW, "text", "es", None)], S.MESSAGES)
    once = upkeep.purge_expired(rows, NOW)
    got = {r["message_id"]: r for r in once.collect()}
    assert got["old"]["body_redacted"] == "" and got["old"]["user_hash"] is None
    assert got["new"]["body_redacted"] == "text"
    assert sorted(upkeep.purge_expired(once, NOW + timedelta(seconds=1)).collect()) == sorted(once.collect())


def test_missing_fact_is_never_evidence(spark):
    links = spark.createDataFrame([("m", None, None, [("https://a.es", "a.es", "a.es", "a.es")])],
                                  "message_id string, claimed_entity string, brand struct<official_domains:array<string>>, "
                                  "links array<struct<url:string,host:string,domain:string,shown_domain:string>>")
    none = spark.createDataFrame([], "domain string, registered_at timestamp, cert_issued_at timestamp")
    moves = spark.createDataFrame([], "url string, hops int, final_domain string")
    got = evidence.network_evidence(links, none, moves, NOW).collect()
    assert {r["signal"]["status"] for r in got} == {"not_applicable"}


def test_readers(spark, tmp_path):
    from vigia.sources import readers
    lines = ['# comment', '', '{"id":"a","label":"scam","message":"m","expected_level":"estafa"}']
    (tmp_path / "ok.jsonl").write_text("\n".join(lines))
    assert readers.read_cases(spark, str(tmp_path / "ok.jsonl")).first()["split"] == "validation"
    (tmp_path / "bad.jsonl").write_text("\n".join([*lines, '{"id":"a"']))
    try:
        readers.read_cases(spark, str(tmp_path / "bad.jsonl"))
        raise AssertionError("accepted a broken line")
    except ValueError:
        pass


def test_classifier(spark, tmp_path):
    from vigia.operators import ml
    texts = [(f"verifica tu cuenta bloqueada numero {i}", "phishing") for i in range(12)] + \
            [(f"nos vemos mañana en casa de ana {i}", "legitimate") for i in range(12)]
    rows = spark.createDataFrame(texts, "text string, label string")
    model = ml.train(rows, max_iter=30)
    model.save(str(tmp_path / "model"))
    got = ml.TextClassifier.load(str(tmp_path / "model")).predict(rows)
    assert got.where("predicted_label <> label").count() == 0
    assert got.where("phishing_probability between 0 and 1").count() == len(texts)
    assert ml.ranking_quality(got)["roc_auc"] == 1.0
    bare = spark.createDataFrame([(None,), ("",)], "text string")
    assert ml.TextClassifier.load(str(tmp_path / "model")).predict(bare).count() == 2


def test_ranking_counts_ties_as_one_step(spark):
    from vigia.operators import ml
    rows = [("phishing", 0.9), ("legitimate", 0.8), ("phishing", 0.8), ("legitimate", 0.1), ("phishing", None)]
    got = ml.ranking_quality(spark.createDataFrame(rows, "label string, phishing_probability double"))
    assert got == {"roc_auc": 0.875, "average_precision": round(0.5 * 1 + 0.5 * 2 / 3, 4)}


def test_analysis_is_stored_in_five_tables(spark, tmp_path):
    from vigia.streaming import jobs
    body = "Tu cuenta ES91 2100 0418 4502 0005 1332 caduca, entra en https://banco-seguro.example/a?token=abc"
    batch = spark.createDataFrame([("m1", body, "BANCO"), ("m2", None, None)], "message_id string, body string, sender string")
    store = jobs.score_batches(b"pepper", str(tmp_path))
    store(batch, 3)
    store(batch, 3)  # a repeated batch replaces its rows
    tables = {name: spark.read.parquet(str(tmp_path / name)) for name in ("messages", "extractions", "signals", "verdicts", "artifacts")}
    assert tables["messages"].count() == tables["verdicts"].count() == 2
    assert {r.artifact_type for r in tables["artifacts"].where("message_id = 'm1'").collect()} >= {"domain"}
    assert not any("2100 0418" in str(r) for df in tables.values() for r in df.collect())


def _terms(text):
    words, out = text.strip().lower().split(), []
    for w in words:
        w = f" {w} "
        for n in (3, 4, 5):
            out += [w[i:i + n] for i in range(max(len(w) - n + 1, 1))] if n == 3 or len(w) > n - 1 else []
    return out


def test_term_model_equals_a_plain_fit(spark):
    """Vocabulary with a cut and ties, weights, and the fitted probabilities against numpy's Newton steps."""
    import math
    from collections import Counter
    import numpy as np
    from vigia.operators import terms
    texts = [("a", "gana premio gratis ya", "phishing"), ("b", "premio gratis hoy mismo", "phishing"), ("c", "tu cita es hoy", "legitimate"),
             ("d", "la cita de hoy", "legitimate"), ("e", "oferta y premio", "spam"), ("f", "oferta de hoy", "spam"), ("g", "", "spam"), ("h", None, "legitimate")]
    df = spark.createDataFrame(texts, "key string, text string, label string").repartition(3)
    counts = {k: Counter(_terms(t or "")) for k, t, _ in texts}
    got = {(r["key"], r["term"]): r["n"] for r in terms.term_counts(df).collect()}
    assert got == {(k, w): n for k, c in counts.items() for w, n in c.items()}
    df_of, total = Counter(w for c in counts.values() for w in c), sum(counts.values(), Counter())
    kept = sorted((w for w in df_of if df_of[w] >= 2), key=lambda w: (-total[w], w))[:25]
    idf = {w: math.log(9 / (1 + df_of[w])) + 1 for w in kept}
    words = terms.vocabulary(terms.term_counts(df), 8, 2, 25)
    assert {r["term"]: round(r["idf"], 9) for r in words.collect()} == {w: round(v, 9) for w, v in idf.items()}
    x = np.zeros((8, 25))
    for row, (k, _, _) in enumerate(texts):
        for col, w in enumerate(kept):
            x[row, col] = (1 + math.log(counts[k][w])) * idf[w] if counts[k][w] else 0
    x /= np.maximum(np.sqrt((x ** 2).sum(1)), 1e-300)[:, None]
    model = terms.train(df, size=25)
    classes = sorted({t[2] for t in texts})
    y = np.array([classes.index(t[2]) for t in texts])
    balance = np.array([8 / (3 * np.sum(y == k)) for k in y])
    w, b = np.zeros((3, 25)), np.zeros(3)
    for _ in range(60_000):  # plain gradient descent to the same optimum
        m = x @ w.T + b
        p = np.exp(m - m.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - np.eye(3)[y]) * balance[:, None]
        w -= 0.15 * (d.T @ x + w / 2.0)
        b -= 0.15 * d.sum(0)
    got = {r["key"]: r["probabilities"] for r in model.probabilities(df).collect()}
    m = x @ w.T + b
    p = np.exp(m - m.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert model.classes == classes and np.abs(np.array([got[t[0]] for t in texts]) - p).max() < 2e-3


def test_shared_artifacts_with_hot_values_against_brute_force(spark):
    """Two values that most messages and campaigns carry, together and apart; a low bound for widespread values."""
    import random
    from vigia.operators import campaigns
    rnd = random.Random(4)
    kinds = ["domain", "phone", "iban", "url_path_template"]

    def some(n, prefix):
        out = set()
        for i in range(n):
            for k in kinds:
                if k in ("domain", "phone") and rnd.random() < 0.7:
                    out.add((f"{prefix}{i}", k, "hot"))
                for _ in range(rnd.randrange(0, 3)):
                    out.add((f"{prefix}{i}", k, f"{k}{rnd.randrange(25)}"))
        return sorted(out)
    wanted, held = some(60, "m"), some(50, "c")
    wanted += [(f"copy{i}", k, v) for i in range(20) for m, k, v in wanted if m == "m1"] + [("n", "iban", None), ("n", "phone", None)]
    w = spark.createDataFrame(wanted, "message_id string, artifact_type string, value_hash string").repartition(3)
    h = spark.createDataFrame(held + held[:9], "campaign_id string, artifact_type string, value_hash string")
    for bound in (0, 5, 1_000):
        for least in (1, 2, 3):
            want = {}
            for m, k, v in wanted:
                for c, k2, v2 in held:
                    if v is not None and (k, v) == (k2, v2):
                        want.setdefault((m, c), set()).add(k)
            want = {p: sorted(t) for p, t in want.items() if len(t) >= least}
            got = campaigns.shared_campaigns(w, h, least, widespread=bound)
            assert {(r[0], r[1]): r[2] for r in got.collect()} == want and got.count() == len(want)


def test_tree_checksum_is_the_same_tree_whatever_the_partitions(spark):
    import hashlib
    values = [f"v{k % 900}" for k in range(2_000)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = {sha(v): sha(v) for v in values}
    for k in (3, 2, 1, 0):
        groups = {}
        for place, digest in level.items():
            groups.setdefault(place[:2 * k], []).append(digest)
        level = {place: sha("".join(sorted(d))) for place, d in groups.items()}
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "value string")
    for parts in (1, 7):
        assert [tuple(r) for r in intel.tree_checksum(df.repartition(parts)).collect()] == [(level[""], 900)]
    assert intel.tree_checksum(df.limit(0)).count() == 0


def test_messages_that_lead_to_the_same_campaigns_share_a_signature(spark):
    """A hundred sets of different values, all held by the same campaigns, are matched as one; a rarer value sets apart."""
    both = [(k, f"{k}{i}") for k in ("phone", "domain") for i in range(100)]
    held = [(f"c{c}", k, v) for c in range(5) for k, v in both] + [("c0", "iban", "own")]
    wanted = [(f"m{v.lstrip('phonedmai')}", k, v) for k, v in both] + [("m7", "iban", "own")]
    w = spark.createDataFrame(wanted, "message_id string, artifact_type string, value_hash string")
    h = spark.createDataFrame(held, "campaign_id string, artifact_type string, value_hash string")
    keys, values = campaigns._signatures(w, h, "message_id")
    assert keys.count() == 100 and keys.select("sig").distinct().count() == 2 and values.count() == 5
    got = {(r[0], r[1]): r[2] for r in campaigns.shared_campaigns(w, h, 2).collect()}
    assert got == brute_shared(wanted, held, 2)


def test_terms_of_keys_in_many_pieces_against_plain_counts(spark, monkeypatch):
    """Null and repeated keys whose words cross the pieces, letters outside the basic plane, sums given early: the
    counts, the sums and the weights are those of plain counting, and no (key, term) row is shuffled."""
    import math
    import random
    from collections import Counter, defaultdict
    from vigia.operators import terms
    monkeypatch.setattr(terms, "_PIECE", 7)
    monkeypatch.setattr(terms, "_SUMS", 20)
    rnd = random.Random(6)
    words = ["uno", "dos", "ÑU", "a", "𝒳y", "字典字典", "x" * 9, "ananan"]
    rows = [(rnd.choice(["k1", "k2", "k3", None, f"s{i}"]), "\n" + " ".join(rnd.choices(words, k=rnd.randrange(0, 30)))) for i in range(60)]
    rows += [("k1", None), ("empty", " \t "), ("empty", None)]
    df = spark.createDataFrame(rows, "key string, text string").repartition(3)
    counts = defaultdict(Counter)
    for k, t in rows:
        counts[k].update(_terms(t or ""))
    got = terms.term_counts(df).collect()
    assert len(got) == len({(r["key"], r["term"]) for r in got})
    assert {(r["key"], r["term"]): r["n"] for r in got} == {(k, w): n for k, c in counts.items() for w, n in c.items()}
    df_of, total = Counter(w for c in counts.values() for w in c), sum(counts.values(), Counter())
    assert {r["term"]: (r["df"], r["total"]) for r in terms.term_totals(df).collect()} == {w: (df_of[w], total[w]) for w in df_of}
    vocabulary = terms.vocabulary(terms.term_totals(df), len(rows), 2, 40)
    idf = {r["term"]: r["idf"] for r in vocabulary.collect()}
    by_join = {(r["key"], r["term"]): round(r["weight"], 9) for r in terms.term_weights(terms.term_counts(df), vocabulary).collect()}
    found = terms.text_weights(df, vocabulary)
    assert "hashpartitioning(term" not in found._jdf.queryExecution().toString()
    weights = {(r["key"], r["term"]): round(r["weight"], 9) for r in found.collect()}
    raw = {k: {w: (1 + math.log(n)) * idf[w] for w, n in c.items() if w in idf} for k, c in counts.items() if k is not None}
    assert weights == by_join == {(k, w): round(x / math.sqrt(sum(y * y for y in c.values())), 9) for k, c in raw.items() for w, x in c.items()}


def test_stored_analysis_scores_its_batch_once(spark, tmp_path):
    from checks.corpus import stored_analysis

    text = "Llame al 912 345 678 y mire https://bit.ly/a"
    spark.createDataFrame([(i, text, "es", "web", len(text)) for i in range(6)],
                          "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f"https://p{i}.example.org/a", "") for i in range(3)],
                          "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, datetime(2024, 1, 1), i, "click") for i in range(6)],
                          "event_id long, ts timestamp, user_id long, event_type string") \
        .write.parquet(str(tmp_path / "events.parquet"))
    rows = stored_analysis(spark, str(tmp_path))
    assert all("/staged-" in name for name in rows.inputFiles())  # nothing above the staged batch runs five times
    found = {r.table_name: (r.rows, r.messages) for r in rows.collect()}
    assert set(found) == {"messages", "extractions", "signals", "verdicts", "artifacts"}
    assert all(found[name] == (6, 6) for name in ("messages", "extractions", "verdicts"))
