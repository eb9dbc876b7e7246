"""Rows that every operator must survive, and small helpers."""

import random

CLASHES = "k long, h long, at long, p long, n long, fp long, found string, marked string, first string, score double, kept string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghioé") for _ in range(rng.randint(1, 9))) for _ in range(n))


def sentences(rng, n):
    return " ".join(words(rng, rng.randint(4, 12)).capitalize() + "." for _ in range(n))


def edge_rows():
    """(doc_id, text) with nulls, empty and blank texts, ties, repeated rows, long texts and odd characters."""
    rng = random.Random(11)
    passage, base = sentences(rng, 9), words(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, words(rng, 40)), (None, None), (4, base), (5, base),
            (6, " ".join(near)), (7, words(rng, 30) + " " + passage + " " + words(rng, 30)),
            (8, sentences(rng, 4) + "\n" + passage), (9, passage), (10, sentences(rng, 6)), (10, sentences(rng, 6)),
            (11, passage), (11, passage), (12, "a" * 3000), (13, "ab" * 400 + " end"), (14, "日本語 テキスト ☃☃\n" * 40),
            (15, "line one here\n" * 30), (16, words(rng, 6000)), (17, "x y　z\x00 \r\n\x0b\x0c q"),
            (18, "the*** and&&& of%%% " * 20), (19, "  two  spaces   three \n\n  lead"), (20, "▁a ▁▁b <s> <unk> <|endoftext|>"),
            (21, "SHOUT LOUD " * 20), (22, "don't we'll I'M 12 345 é")]
    rows += [(30 + i, words(rng, 25) + " " + passage[:260] + " " + words(rng, 25)) for i in range(12)]
    return rows


def frame(spark, rows, clash=True):
    """doc_id, text and, with ``clash``, columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if clash:
        for c in CLASHES.split(", "):
            name, kind = c.split()
            from pyspark.sql import functions as F
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def documents(spark, sf="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{sf}/documents.parquet")
