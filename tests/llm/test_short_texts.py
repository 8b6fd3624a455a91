"""Texts of one or two lines in line dedup."""

from webframe.llm import line_dedup


def test_short_texts_that_repeat_are_removed_if_asked_for(docs):
    rows = [(1, "one line"), (2, " one line "), (3, "a\n\nb"), (4, "a\nb"), (5, "b\na"), (6, "p\nq\nr"), (7, "p\nq\nr\ns"), (8, "p\nq"), (9, None), (10, "")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs(rows), short=True).collect()}
    plain = {i: (t, 0) for i, t in rows}
    assert got == plain | {2: ("", 1), 4: ("", 2), 7: ("s", 3)}
    assert {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs(rows)).collect()} == plain | {7: ("s", 3)}
