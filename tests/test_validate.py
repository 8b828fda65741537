import random

from cueloom.operators import annotate, validate

SCHEMA = "k int, expected_ids array<string>, utterances array<struct<id:string,source_ids:array<string>>>, context_ids array<string>"
CASES = [
    (0, ["U000001", "U000002"], [("U000001", ["U000001"]), ("U000002", ["U000002"])], None, True, ""),
    (1, ["U000001", "U000002"], [("U000001", ["U000001"])], None, False, "missing"),
    (2, ["U000001"], [("U000001", ["U000001"]), ("U000002", ["U000001"])], None, False, "duplicate"),
    (3, ["U000001"], [("U000001", ["U000001", "U999999"])], None, False, "unknown"),
    (4, ["U000001"], [("U000001", ["U000001"]), ("V_INSERT_001", [])], None, True, ""),
    (5, ["U000001", "U000002", "U000003"], [("U000001", ["U000001", "U000002", "U000003"])], None, True, ""),
    (6, ["U000001", "U000002", "U000003"], [("U000001", ["U000001", "U000003"]), ("U000002", ["U000002"])], None, True, ""),
    (7, ["U000001"], [], None, False, "no utterances"),
    (8, ["U000001"], None, None, False, "no utterances"),
    (9, ["U000001"], [("1", ["U000001"])], None, False, "format"),
    (10, ["U000001"], [("U000999", ["U000001"])], None, False, "unexpected"),
    (11, ["U000001"], [("U000001", ["U000001", "U000009"])], ["U000009"], False, "unknown"),
    (12, ["U000001"], [("U000001", ["U000001", None])], None, None, ""),
    (13, None, [("V_INSERT_1", None)], None, True, ""),
]


def test_cases(spark):
    df = spark.createDataFrame([c[:4] for c in CASES], SCHEMA)
    got = {r["k"]: r for r in validate.validate(df).collect()}
    for k, _, _, _, passed, word in CASES:
        if passed is not None:
            assert got[k]["passed"] is passed, k
            assert word in "; ".join(got[k]["errors"]), k
    assert got[6]["non_contiguous"] == ["U000001"] and got[6]["warnings"]
    assert got[11]["leaked_ids"] == ["U000009"]
    assert got[2]["duplicate_ids"] == ["U000001"] and got[3]["unknown_ids"] == ["U999999"]


def test_same_errors_between_calls(spark):
    df = spark.createDataFrame([c[:4] for c in CASES[:12]], SCHEMA)
    got = {r["k"]: r["errors"] for r in validate.validate(df).collect()}
    for k, expected, utts, *_ in CASES[:12]:
        own = annotate.check_ids({"utterances": [{"id": i, "source_ids": s} for i, s in utts or []]}, expected)
        assert own == got[k], k


def test_same_errors_of_any_answer(spark):
    """The check between two calls and the check of a table say the same of random answers."""
    rng = random.Random(7)
    ids = [f"U{i:06d}" for i in range(1, 9)] + ["V_INSERT_001", "X1", ""]
    rows = []
    for k in range(300):
        utts = [(rng.choice(ids), [rng.choice(ids[:9]) for _ in range(rng.randint(0, 4))]) for _ in range(rng.randint(0, 5))]
        rows.append((k, ids[: rng.randint(0, 7)], utts, None))
    got = {r["k"]: r["errors"] for r in validate.validate(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, expected, utts, _ in rows:
        assert annotate.check_ids({"utterances": [{"id": i, "source_ids": s} for i, s in utts]}, expected) == got[k], (k, expected, utts)
