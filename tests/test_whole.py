"""Queries whose rows are held against plain Python over the whole tables."""

import re
import uuid
from collections import defaultdict
from hashlib import md5

import pandas as pd
from kbforge import plans
from kbforge.functions import helpers
from kbforge.operators import corpus as ops

from tests.oracle import SF

QUERIES = plans.queries()


def table(name: str) -> pd.DataFrame:
    return pd.read_parquet(f"{SF}/{name}.parquet")


def digest(text: str | None) -> str | None:
    return None if text is None else md5(text.encode()).hexdigest()


def rio(text: str) -> str:
    text = re.sub(r"\bRIO[-\s]?Live\b", "RIO +LAN", text, flags=re.I | re.A)
    return re.sub(r"\bRIO\s*\+\s*WAN\s+Live\b", "RIO +LAN", text, flags=re.I | re.A)


def test_every_event_has_its_mail_date(spark):
    want = {e.event_id: None if e.event_id % 20 and e.event_id % 30 == 0 else str(e.ts)[:19] for e in table("events").itertuples()}
    got = QUERIES["parse_mail_date"](spark, SF).collect()
    assert len(got) == len(want) and {r.event_id: r.at for r in got} == want


def test_all_hits_of_an_order_have_context(spark):
    lines, names = table("lineitem"), dict(table("supplier")[["s_suppkey", "s_name"]].itertuples(index=False))
    makers, found = defaultdict(set), defaultdict(set)
    for x in lines.itertuples():
        makers[x.l_partkey].add(names[x.l_suppkey])
    for x in lines.itertuples():
        if x.l_linenumber <= 10:
            found[x.l_orderkey] |= makers[x.l_partkey]
    got = QUERIES["graph_context"](spark, SF).collect()
    assert {(r.query_id, r.label, r.names) for r in got} == {(q, "Supplier", ", ".join(sorted(n)[:3])) for q, n in found.items()}


def test_all_chunks_are_merged_with_their_whole_texts(spark):
    for name, n, batch in (("upsert_chunks", 3, 2), ("replace_by_field", 4, 3)):
        want = set()
        for x in table("documents").itertuples():
            for k, at in enumerate(range(0, max(1, len(x.text)), 1000)):
                b = batch if x.doc_id % n == 0 else 1
                want.add((["docs", "cases"][x.doc_id % 2], str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{x.doc_id}_{k}")), md5(f"{b}:{x.text[at : at + 1000]}".encode()).hexdigest(), b))
        got = QUERIES[name](spark, SF).collect()
        assert len(got) == len(want) and {(r.collection, r.chunk_id, r.digest, r.batch) for r in got} == want


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_texts_are_read_to_their_ends(spark, tmp_path):
    """What counts lies far behind the first words."""
    body = "Plain words before it. " * 900
    texts = {9: body + "Ends with rio-live and RIO + WAN live", 19: "abcdUNIQUE" + body, 2: body, 3: ""}
    write(spark, tmp_path, "documents", [(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, tmp_path, "labels", [(i, 1, 0) for i in texts], "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "benchmark", list(texts.items()), "item_id long, text string")
    run = lambda name: {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert run("term_transforms") == {(i, digest(rio("the RIO-live and rio + wan live " + t))) for i, t in texts.items()}
    assert run("case_document") == {(i, digest(f"# Support Case: S{i}\n\n**Category:** en\n**Product:** s\n**Status:** resolved\n**Keywords:** en, s\n\n## Problem\n{t[:40]}\n\n## Solution\n{t[40:]}")) for i, t in texts.items()}
    base = {i: ("rio live " if i % 2 else "plain ") + t for i, t in texts.items()}
    assert run("query_variants") == {(i, digest(rio(b)) if rio(b) != b else None, digest(rio(b))) for i, b in base.items()}
    fixed = {i: t[:k] + "<FIX>" + t[k + 6 :] if i % 10 == 9 and (k := t.lower().find(t[4:10].lower())) >= 0 else t for i, t in texts.items()}
    assert run("auto_apply_fixes") == {(i, digest(t), int(t != texts[i])) for i, t in fixed.items()}


def test_placeholders_of_a_thread(spark):
    rows = [(1, i, f"unit CY-A123-{i // 40}-{i % 40}, again cy-a123-0-{i % 7}") for i in range(1100)]
    got = {r.turn: r.text for r in ops.anonymize_threads(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(5)).collect()}
    # Numbers stay whole in long threads, where they look like phone numbers.
    assert got == {i: f"unit [SERIAL:A123-{i + 1}], again [SERIAL:A123-{i % 7 + 1 if i else 1}]" for i in range(1100)}


def test_anonymized_like_the_thread_at_once(spark):
    odd = ["a@own.com b@x.org 030-1234567", None, "", "B@X.ORG cy-cam-1-2@x.com +49 170 1234567 and 5551234567", "CY-CAM-1-2 1234567@own.com CY-CAM-1-2555 12 34", "CY-PTZ-9-9 5551234567c@d.ef[EMAIL-1]"]
    docs = [(x.doc_id % 5, x.doc_id, x.text) for x in table("documents").itertuples()] + [(100 + k, 7 - i, t) for k in range(2) for i, t in enumerate(odd)] + [(None, i, t) for i, t in enumerate(odd)]
    turns = spark.createDataFrame(docs, "conv_id long, turn long, text string").repartition(7)
    for own in ("", "own.com"):
        out, want = ops.anonymize_threads(turns, own_domain=own), {}
        assert "InPandas" not in out._jdf.queryExecution().toString()
        for thread in {t for t, _, _ in docs}:
            mine = sorted((n, x) for t, n, x in docs if t == thread)
            want |= {(thread, n): x for (n, _), x in zip(mine, helpers.anonymize([x for _, x in mine], own))}
        assert {(r.conv_id, r.turn): r.text for r in out.collect()} == want and out.count() == len(docs)
