"""Joins that are the same at all sizes, and groups that are looked at again only if they are large."""

from __future__ import annotations

from codeloom.llm import jaccard_join, line_dedup


def test_rows_join_their_places_by_one_plan(spark):
    docs = spark.createDataFrame([(i, f"one\ntwo\nthree\n{i}") for i in range(6)], "doc_id long, text string")
    out = line_dedup.remove_repeated_lines(docs)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "one\ntwo\nthree\n0", **{i: str(i) for i in range(1, 6)}}


def test_sizes_of_small_groups_are_taken_once(spark, monkeypatch):
    """After the first time only members of large groups are joined to their group's size."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words, f"x{i}"])) for i in range(40)] + [(100 + i, " ".join(f"{i}v{j}" for j in range(30))) for i in range(50)]
    seen, sized = [], jaccard_join._with_size
    monkeypatch.setattr(jaccard_join, "_with_size", lambda reps, total: seen.append(reps.count()) or sized(reps, total))
    kept = jaccard_join.keep_one_per_component(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, *range(100, 150)]
    assert seen[0] == 90 and len(seen) > 1 and all(n <= 40 for n in seen[1:])
