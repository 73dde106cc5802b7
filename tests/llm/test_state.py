from clausewright.llm import lines


def test_a_later_partition_loses_lines_that_crossed_earlier(spark):
    make = lambda a, b: spark.createDataFrame([(f"c{i}", "s", f"body {'abcdefghijkl'[i]}\nfooter line") for i in range(a, b)], "id string, source string, text string")
    state, over = lines.LineState.empty(make(0, 1)).merge(make(0, 6))
    assert over.count() == 1
    state, over = state.merge(make(6, 8))
    assert sorted(tuple(r) for r in lines.marked_lines(make(6, 8), over).collect()) == [("c6", 2), ("c7", 2)]
    assert state.merge(make(0, 8))[1].count() == 0


def test_deltas_equal_the_whole_and_follow_changed_records(spark):
    make = lambda rows: spark.createDataFrame(rows, "id string, source string, text string")
    body = lambda i: f"body {'abcdefghijkl'[i]}"
    first = make([(f"c{i}", "s", f"{body(i)}\nFooter  {i}") for i in range(5)] + [("c0", "s", f"{body(0)}\nFooter  0"), ("x", "t", None), (None, "s", "footer 1")])
    second = make([("c5", "s", f"footer 9\n{body(5)}"), ("c6", "s", "footer 1\n123")])
    parts = [lines.records(p, "id", "source", "text") for p in (first, second)]
    got = {tuple(r) for r in lines.in_deltas(parts).collect()}
    assert got == {(f"c{i}", 2) for i in range(5)} | {("c5", 1), ("c6", 1)}
    assert got == {tuple(r) for r in lines.repeated_lines(first.unionByName(second), "id", "source", "text").collect()}
    again = make([("c0", "s", body(0)), ("c1", "s", body(1))])  # two lose the line: five are left
    assert lines.in_deltas([*parts, again]).count() == 0
    state = lines.LineState.empty(first)
    for p in parts:
        state = state.advance(p).state
    step = state.advance(again)
    assert {tuple(r) for r in step.cleared.collect()} >= {(f"c{i}", 2) for i in range(5)} and step.marked.count() == 0
    assert lines.in_deltas([]) is None and lines.in_deltas([make([])]).count() == 0


def test_lines_of_many_records_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(lines, "PER_TASK", 4)
    df = spark.createDataFrame([(f"c{i}", "s", f"body {'abcdefghijklmnopqrst'[i]}\nfooter") for i in range(20)], "chunk_id string, source_id string, text string")
    for few in (0, 10):
        monkeypatch.setattr(lines, "FEW", few)
        assert {tuple(r) for r in lines.repeated_lines(df).collect()} == {(f"c{i}", 2) for i in range(20)}
