"""Rows that every operator must get right: nulls, empty and very long texts, repeated rows, odd characters."""

EDGES = [(1, None), (2, ""), (3, " \n "), (4, "plain words here"), (4, "plain words here"), (5, "x" * 200_000), (6, "é 你好 😀\x00\x1c <|endoftext|>"), (None, "no key"), (7, "a  b\n\nc ")]
