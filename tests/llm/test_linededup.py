from lustrum.llm import linededup


def slow(rows):
    """The same by dictionaries; rows alike in id and text are one document."""
    first, gone = {}, {}
    order = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in order:
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(x.strip(" ") for x in w) and first.setdefault(w, (i, t, p)) != (i, t, p):
                gone.setdefault((i, t), set()).update((p, p + 1, p + 2))
    out = []
    for i, t in rows:
        drop = gone.get((i, t), set())
        lines = [] if t is None else t.split("\n")
        out.append((i, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in drop), len(lines), len(drop)))
    return sorted(map(str, out))


CASES = [
    (1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nd\na\nb\nc"), (4, "a\nb"), (5, ""), (6, None), (7, "q\n\n\n\nq"), (8, "r\n\n\n\nr"),
    (9, "k\nk\nk\nk\nk"), (10, "a\nb\nc\nd"), (10, "a\nb\nc\nd"), (11, "z " * 3000 + "\n1\n2\n3"), (12, "1\n2\n3"), (13, " \n \n "), (14, "\t\n \n "), (None, "a\nb\nc"), (None, None),
]


def test_against_dictionaries(make_docs):
    docs = make_docs(CASES, extra=True)
    out = linededup.line_dedup(docs)
    assert out.columns == [*docs.columns, "__n_lines", "__n_removed"]
    got = [(r["doc_id"], r["text"], r["__n_lines"], r["__n_removed"]) for r in out.collect()]
    assert sorted(map(str, got)) == slow(CASES)


def test_corpus(make_docs, corpus):
    rows = [r for r in corpus if r[0] is not None and r != (42, "another text with the same id")]
    got = [(r["doc_id"], r["text"], r["__n_lines"], r["__n_removed"]) for r in linededup.line_dedup(make_docs(rows)).collect()]
    assert sorted(map(str, got)) == slow(rows)


def test_empty_table(make_docs):
    assert linededup.line_dedup(make_docs([])).collect() == []


def test_texts_that_are_shuffled_whole_and_clashing_columns(make_docs, monkeypatch):
    from pyspark.sql import functions as F

    docs = make_docs(CASES)
    for name in ("__id", "__TH", "__starts", "__lines", "__covered", "__mark", "starts", "th"):
        docs = docs.withColumn(name, F.lit("kept"))
    got = {}
    for bound in (linededup.BROADCAST, 0):
        monkeypatch.setattr(linededup, "BROADCAST", bound)
        out = linededup.line_dedup(docs)
        rows = out.collect()
        assert all(r["__lines"] == r["__TH"] == "kept" for r in rows)
        got[bound] = sorted(str((r["doc_id"], r["text"], r["__n_lines"], r["__n_removed"])) for r in rows)
    assert got[0] == got[1_000_000] == slow(CASES)
