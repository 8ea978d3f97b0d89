"""Markdown: each row is a text of its own, and what counts as heading and fence."""

from loomgraph.sources import extract

TEXTS = [
    ("/a", "# One\n```go\n# no\n```\n## Two\nx"), ("/a", "x\n```\n# Three\n"), ("/a", "### Four \n"), (None, "x\n# Five"), ("/n", None), ("/e", ""),
    ("/b", " # no\n#no\n####### no\n#   \n#\x0b Six\x0b\n  ```py3 x\n ~~~\n```\n\t```é\n# in\n```\n######\tSeven # \r\n#\u00a0no\n# \u00a0Eight"),
]


def test_texts_of_one_path_stay_apart(spark):
    got = extract.markdown(spark.createDataFrame(TEXTS, "file_path string, text string"))
    assert got.columns == ["file_path", "heading", "node_type", "name", "start_line"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [
        ("/a", "One", "type", "One", 1), ("/a", "One", "method", "code_go_2", 2), ("/a", "Two", "type", "Two", 5), ("/a", "", "method", "code_text_2", 2), ("/a", "Four", "type", "Four", 1),
        (None, "Five", "type", "Five", 2), ("/b", "Six\x0b", "type", "Six\x0b", 5), ("/b", "Six\x0b", "method", "code_py3_6", 6), ("/b", "Six\x0b", "method", "code_text_9", 9),
        ("/b", "Seven # \r", "type", "Seven # \r", 12), ("/b", "\u00a0Eight", "type", "\u00a0Eight", 14),
    ]))
