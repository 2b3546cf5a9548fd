"""Cases in which an operator once did less than the whole job."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

from panelwright.llm import jaccard  # noqa: E402


def test_jaccard_of_passages_in_texts_of_differing_lengths(spark):
    """A common passage lies behind what is a text's own, so the longer text's prefix ends in the passage before the shorter one's does."""
    rows = []
    for f in range(4):
        own = lambda tag, n, f=f: [f"f{f}{tag}{i}" for i in range(n)]
        p = own("p", 86)
        # x and y are linked; w and z are linked with nothing, but are the smallest set and the neighbour of the tokens x and y share
        for words in (p + own("x", 18), p + own("y", 8), p[:72] + own("w", 12), p[2:84] + own("z", 17), p + own("u", 60), p + own("v", 60)):
            rows.append((len(rows), " ".join(words)))
    r = random.Random(3)
    base = [f"b{i}" for i in range(160)]
    for c in range(40):  # truncated copies, some with an end of their own
        a = r.randrange(40)
        words = base[a : r.randrange(100, 160)] + [f"c{c}_{i}" for i in range(r.choice([0, 6, 14, 25]))]
        rows.append((len(rows), " ".join(words)))
    want = sorted(brute.shingle_components(rows))
    assert want[0][2] == want[1][2]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(tuple(x) for x in jaccard.near_duplicates(df).collect()) == want


def test_jaccard_of_texts_around_one_template(spark):
    """Texts that share most of their words and are linked with nothing, and some that are linked; whatever tasks hold them."""
    base = [f"t{i}" for i in range(130)]
    rows = [(i, " ".join(base + [f"d{i}_{k}" for k in range(34)])) for i in range(240)]
    for c in range(6):  # linked with row 0, each in another way
        words = base + [f"d0_{k}" for k in range(34)]
        words[20 * c + 3] = f"x{c}"
        rows.append((1000 + c, " ".join(words[c:])))
    for n in (20, 60, 110):  # sizes of other bands, part of the template alone
        rows += [(2000 + n, " ".join(base[:n])), (3000 + n, " ".join(base[: n - 2])), (4000 + n, " ".join(base[: n // 2]))]
    want = sorted(brute.shingle_components(rows))
    assert len({c for *_, c in want}) < len(rows) - 6
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for dealt in (df.coalesce(1), df.repartition(5)):
        assert sorted(tuple(x) for x in jaccard.near_duplicates(dealt, hot=8).collect()) == want


def test_one_of_each_keeps_columns_with_dots(spark):
    df = spark.createDataFrame([(1, "one text", 5), (2, "one text", 6)], "doc_id long, text string, `a.b` int")
    out = jaccard.one_of_each(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "one text", 5)]
