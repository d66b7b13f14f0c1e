import random

from kbforge.functions import helpers
from kbforge.operators import corpus as ops


def test_fixes_are_folded_without_python(spark):
    rnd = random.Random(6)
    word = lambda: rnd.choice(["aB", "Ab c", "É", "é", "İx", "x", "ẞ", "ΑΣ", "", "\U0001f600q", None])
    rows = [(i, rnd.choice([None, "", "".join((word() or " ") + " " for _ in range(rnd.randrange(30)))])) for i in range(300)]
    fixes = [(i, k, word(), word() or "", 0.9, "spelling") for i, _ in rows for k in range(rnd.randrange(5))]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    asked = spark.createDataFrame(fixes, "chunk_id long, at int, original_text string, suggested_text string, confidence double, suggestion_type string")
    found = ops.auto_apply_fixes(chunks, asked)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    own = lambda i: [(a, b) for _, _, a, b, _, _ in sorted((f for f in fixes if f[0] == i), key=lambda f: (f[1], f[2] is not None, f[2] or "", f[3]))]
    assert {r.chunk_id: (r.text, r.applied) for r in found.collect()} == {i: helpers.apply_fixes(t, own(i)) for i, t in rows}
