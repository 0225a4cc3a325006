"""Small awkward tables shared by the tests of the training-data operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward_texts(seed: int = 0) -> list:
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(1, 60)) for _ in range(30)]
    return [
        None, "", " ", "\n", "\n\n \n", "a", "\t a\n b ", "naïve Ünï ΣΑΣ ÉÀ 日本語 😀", "x" * 5000, sentence(rng, 6000),
        "A line\nof many\n a LINE \nLast", "é ́a Å 12345 don't we'll I'M '' 's", "▁▁a ▁", "\x00\x01\x1c a\x85b\xa0c", "<|endoftext|> a\n\n<|startoftext|>b",
        *base, *base[:10], *[base[0]] * 40, *[t + " extra" for t in base[:5]],
    ]


def documents(spark, texts=None, extra=False):
    """The texts as documents; with null and repeated ids, and columns whose names clash, if asked."""
    texts = awkward_texts() if texts is None else texts
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 3 else "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    if not extra:
        return spark.createDataFrame(rows, DOCS)
    rows = [(None if i % 7 == 0 else i, *r[1:], "own", 1, 2.0, "t", True) for i, r in enumerate(rows)] + [(5, *rows[5][1:], "own", 1, 2.0, "t", True)] * 2
    return spark.createDataFrame(rows, DOCS + ", shard string, slot int, score double, t string, kept boolean").withColumnRenamed("slot", "N_lines")
