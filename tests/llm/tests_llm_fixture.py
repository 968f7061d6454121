"""Tables of six good documents and some bad ones."""

import random

ITEM = "Seven silver swans swam silently seaward while the patient keeper of the light counted every wave that night."


def prose(n, seed):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 9))) for _ in range(n))


def write_tables(spark, path):
    passage = prose(60, 9)
    one = prose(200, 1)
    rows = [(1, one), (2, one + " end"), (3, prose(100, 3) + "\n" + passage), (4, prose(100, 4) + "\n" + passage), (5, prose(80, 5) + " " + ITEM), (6, prose(90, 6)), (7, "too short"), (8, "again and again " * 60), (9, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
