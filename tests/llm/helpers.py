"""Small tables and brute-force versions."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"

#: Nulls in every column, empty and long texts, repeated rows, and a clashing name.
ODD = [(1, "One two three. Four five six."), (1, "One two three. Four five six."), (2, None), (None, "A text without an id."),
       (None, None), (3, ""), (4, " \n\t "), (5, "word " * 20000), (6, "é▁漢😀 \x00 x")]


def odd(spark, extra="score double, text2 string, _x int"):
    """The odd rows with extra columns (names and types)."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for name, kind in (part.split() for part in extra.split(",")):
        df = df.withColumn(name, F.lit("1").cast(kind))
    return df


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def components(texts, least=75):
    """Smallest linked id of every id, by all pairs."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    tried = set()
    for ids in holders.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in tried:
                    tried.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= least * (len(sets[a]) + len(sets[b]) - common):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def texts_of(spark, folder=SF):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
