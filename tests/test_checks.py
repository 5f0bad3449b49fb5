"""Queries of ``checks`` over small tables of their own."""

from datetime import datetime

import pyarrow.parquet as pq
import pytest

TEXT = "Llame al 912 345 678 y mire https://bit.ly/a con su cuenta"


def write_tables(spark, root, texts, toxic=()):
    """documents, labels, pages and events at ``root``, one document a text."""
    n = len(texts)
    root.mkdir(exist_ok=True)
    tables = {
        "documents": ([(i, t, "es", "web", len(t)) for i, t in enumerate(texts)],
                      "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, i % 2, int(i in toxic)) for i in range(n)], "doc_id long, quality int, toxic int"),
        "pages": ([(i, f"https://p{i}.example.org/a", "") for i in range(3)], "page_id long, url string, html string"),
        "events": ([(i, datetime(2024, 1, 25, i % 24), i, ("click", "purchase", "view")[i % 3], 1.5 * i, '{"k": 1}')
                    for i in range(n)],
                   "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
    }
    for name, (rows, schema) in tables.items():
        pq.write_table(spark.createDataFrame(rows, schema).toArrow(), f"{root}/{name}.parquet")  # one file, as the given ones
    return str(root)


def test_stored_analysis_digests_all_that_is_stored(spark, tmp_path):
    from checks.corpus import stored_analysis

    digests = []
    for n, texts in enumerate(([TEXT, "Hola"], [TEXT, "Adios"])):
        rows = stored_analysis(spark, write_tables(spark, tmp_path / str(n), texts)).collect()
        digests.append({r.table_name: (r.rows, r.digest) for r in rows})
    assert all(digests[0][name][0] == digests[1][name][0] for name in ("messages", "extractions", "verdicts"))
    assert digests[0]["messages"] != digests[1]["messages"]  # only a body differs


def test_table_digests_see_every_column_and_copy_but_no_order(spark):
    from vigia.sources.writers import table_digests

    def digest(rows, parts=1):
        df = spark.createDataFrame(rows, "message_id string, a string, b array<int>").repartition(parts)
        return table_digests({"t": df}).first().digest

    rows = [("m1", "x", [1]), ("m2", None, None)]
    assert digest(rows) == digest(rows[::-1], 3)
    others = [[("m1", "x", [2]), rows[1]], [rows[0], ("m2", "", None)], rows + rows[:1], rows + rows + rows]
    assert len({digest(r) for r in [rows, *others]}) == 5


def test_stix_export_scores_its_batch_once(spark, tmp_path):
    from checks.corpus import stix_export

    rows = stix_export(spark, write_tables(spark, tmp_path, [TEXT, "Hola"]))
    assert all("/staged-" in name for name in rows.inputFiles())
    assert {r.message_id for r in rows.collect()} == {"m0", "m1"}


@pytest.mark.parametrize("query", ["campaign_text", "campaign_rollup"])
def test_campaign_queries_work_fingerprints_out_once(spark, tmp_path, query):
    from checks import store

    rows = getattr(store, query)(spark, write_tables(spark, tmp_path, [TEXT, TEXT + " ya", "Otra cosa distinta"], toxic=(0,)))
    plan = rows._jdf.queryExecution().toString()  # holds staged fingerprints only
    assert "ArrowEvalPython" not in plan
    assert rows.count()


def test_store_verdicts_plans_one_source_at_a_time(spark, tmp_path):
    from checks.whole import store_verdicts

    rows = store_verdicts(spark, write_tables(spark, tmp_path, [TEXT, TEXT, "Hola"], toxic=(0,)))
    assert all("/staged-" in name for name in rows.inputFiles())
    assert {r.message_id for r in rows.collect()} == {"m0", "m1", "m2"}


def test_sightings_fingerprint_once_and_reviews_hunt_once(spark, tmp_path, monkeypatch):
    from checks import store, streams
    from vigia.functions import text
    from vigia.operators import hunt

    calls = []
    simhash, campaigns = text.simhash, hunt.hunt_campaigns
    monkeypatch.setattr(text, "simhash", lambda c: calls.append("print") or simhash(c))
    monkeypatch.setattr(hunt, "hunt_campaigns", lambda *a, **b: calls.append("hunt") or campaigns(*a, **b))
    root = write_tables(spark, tmp_path, [TEXT, TEXT + " ya", "Otra cosa distinta", TEXT], toxic=(0, 3))
    found = {(r.message_id, r.campaign_id) for r in streams.stream_sightings(spark, root).collect()}
    assert {(0, 0), (3, 3), (3, 0)} <= found and (0, 3) not in found
    assert calls == ["print"]
    store.review_enqueue(spark, root).collect()
    assert calls == ["print", "hunt"]
