from quadrat.llm import linededup


def brute(rows):
    """rows: (id, text) with distinct ids -> {id: (text, removed)}"""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        gone = set()
        for at in range(len(lines) - 2):
            w = tuple(lines[at : at + 3])
            if not any(c not in " \t\r\v\f" for x in w for c in x):
                continue
            if w in seen:
                gone |= {at, at + 1, at + 2}
            seen.add(w)
        out[i] = (text if not gone else "\n".join(x for n, x in enumerate(lines) if n not in gone), sorted(gone))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, starts string, at int")
    done = linededup.dedup_lines(df, removed_col="removed")
    assert done.columns == [*df.columns, "removed"]
    got = done.collect()
    assert {r.doc_id: (r.text, list(r.removed)) for r in got} == brute(rows) and len(got) == len(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a\nb"), (4, "a\nb\nc\nd\ne"), (5, "x\na\nb\nc\ny"), (6, "a\nb\nc\nd\ne"), (7, "\n\n\n\n"), (8, " \n\t\n\r\nq"), (9, "\n\n\n\n"), (None, "b\nc\nd"), (10, "r\nr\nr\nr\nr\nr"), (11, "é\n" * 5000), (12, "é\n" * 3 + "end")]
    check(spark, rows)


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in linededup.dedup_lines(df).collect()) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "d")]


def test_texts_that_share_an_id(spark):
    """Different texts under a null or repeated id are documents of their own: each loses only its own repeats."""
    rows = [(None, "p\nq\nr\nown"), (None, "1\n2\np\nq\nr"), (None, "u\nv\nw\nx\ny"), (7, "g\nh\ni"), (7, "j\nk\nl\nm"), (7, "g\nh\ni\nend"), (7, "g\nh\ni")]
    got = [(r.doc_id, r.text) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows) and (None, "u\nv\nw\nx\ny") in got and (7, "j\nk\nl\nm") in got
    null, seven = ([t for k, t in got if k == i] for i in (None, 7))
    assert sorted(null) in (sorted(["p\nq\nr\nown", "1\n2", "u\nv\nw\nx\ny"]), sorted(["own", "1\n2\np\nq\nr", "u\nv\nw\nx\ny"]))
    assert sorted(seven) in (sorted(["g\nh\ni"] * 2 + ["end", "j\nk\nl\nm"]), sorted(["", "", "g\nh\ni\nend", "j\nk\nl\nm"]))


def test_empty(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_documents(spark, sf):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
