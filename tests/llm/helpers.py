from __future__ import annotations

import random
import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
#: Columns whose names the operators use themselves.
CLASHING = ["rid", "score", "kept", "keep_id", "label", "weight", "h", "s1", "n", "piece", "length", "run", "own", "word"]

WORDS = {"en": "the and of river house light small stone under walking green paper table".split(), "de": "der und das fluss haus licht klein stein unter gehend grün papier tisch größe".split(), "fr": "le et la rivière maison lumière petit pierre sous marchant vert papier été".split(), "es": "el y la río casa luz pequeño piedra bajo andando verde papel niño".split()}
INSULTS = ["idiot", "moron", "scum"]


def corpus(n: int, seed: int = 1) -> tuple[list[tuple], list[tuple]]:
    """Documents of four languages, a quarter of them junk or toxic, and their labels."""
    chance, docs, labels = random.Random(seed), [], []
    for k in range(n):
        lang = chance.choice(list(WORDS))
        words = [chance.choice(WORDS[lang]) for _ in range(chance.randrange(20, 120))]
        bad, toxic = chance.random() < 0.2, chance.random() < 0.2
        if toxic:
            for _ in range(2):
                words.insert(chance.randrange(len(words)), chance.choice(INSULTS))
        text = " ".join(w + "%%%" for w in words) if bad else (" ".join(words).capitalize() + ".")
        docs.append((k, text, lang, f"src{k % 3}", len(text)))
        labels.append((k, int(not bad), int(toxic)))
    return docs, labels


def odd_documents() -> list[tuple]:
    """Nulls in every column, empty and blank texts, one word, a very long text, and rows that are repeated whole."""
    long = " ".join(f"w{k % 5000}" for k in range(60_000))
    rows = [(1, None, None, None, None), (None, "some text without an id here", "en", "s", 28), (2, "", "en", None, 0), (3, " \t\n\x0b\x0c\r ", None, "s", 7), (4, "word", "en", "s", 4), (5, long, "en", "s", len(long))]
    rows += [(6, "the very same row twice over and over", "en", "s", 37)] * 2 + [(7, "the very same  row twice over and over", "en", "s", 38), (8, "日本語 😀 <|endoftext|> Σ́ é", "xx", "s", 5), (9, "1234 5678", "en", "s", 9)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in CLASHING})


def words_of(text: str | None) -> list[str]:
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))


def shingle_set(text: str | None) -> frozenset:
    words = words_of(text)
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])
