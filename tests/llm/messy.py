"""Small tables with everything that real ones have: nulls, empty and long texts, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, kept string, copies string, row_number string"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


def rows():
    base = prose(120, 1)
    near = base.split()
    near[60] = "changed"
    texts = [
        base, base, " ".join(near), base.upper(), base + " " + prose(4, 2), None, "", "  \n\t ", "one two", "One TWO", "one two three", prose(3000, 3), prose(3000, 3) + "\n" + base,
        "a b c d e", "a b c d e f", "ünï cödé wörds hére äll", "a\x00b   c\r\nd\x1c e", "\n".join([prose(30, 4)] * 4), "\n".join([prose(30, 4), prose(20, 5), prose(30, 4)]),
        "x" * 250, "x" * 251, "ab" * 200, prose(60, 6) + " | # * $ % & < >", prose(80, 7) + ".\n" + prose(60, 8), prose(70, 9) + ".\n" + prose(60, 8),
    ]
    out = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "clash", None, "x", "y", "z") for i, t in enumerate(texts)]
    out.append(out[3])  # a repeated row
    out.append((None, base, None, None, None, None, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None, None, None))
    return out


def table(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)
