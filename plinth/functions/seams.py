"""Places where a model of one's own is plugged in, callable from SQL: embedders as a vectorised function, providers of answers as a table function.

    seams.register(spark)                                   # the hashed embedder and the stub provider
    spark.sql("SELECT id, plinth_embed(text) FROM questions")
    spark.sql("SELECT * FROM plinth_answer(TABLE(SELECT id, prompt FROM prompts))")
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

#: Texts -> a row of numbers for each.
Embedder = Callable[[list[str]], np.ndarray]
#: A prompt -> (answer, tokens of the prompt, tokens of the answer, tokens that a cache held).
Provider = Callable[[str], tuple[str, int, int, int]]
#: Name -> what makes one, on a worker, from keywords. Callers add their own before they register it.
EMBEDDERS: dict[str, Callable[..., Embedder]] = {}
PROVIDERS: dict[str, Callable[..., Provider]] = {}


def hashed(size: int = 1024) -> Embedder:
    """Counts of tokens by hash bucket, glued ones too, of length 1; a text without tokens is all zeros."""
    from ..operators.retrieval import Counter

    counter = Counter(size)

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for row, text in zip(out, texts, strict=True):
            bucket, n = counter(text.lower())
            row[bucket] = n
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)

    return embed


def stub() -> Provider:
    """What grading.stub_answer says: no model is asked."""

    def answer(prompt: str) -> tuple[str, int, int, int]:
        line = next((x for x in prompt.split("\n") if x.lstrip(" ").startswith("[")), "").strip(" ")
        text = f"[stub:{hashlib.sha1(prompt.encode()).hexdigest()[:8]}] {line}"
        return text, max(1, len(prompt)) // 4, max(1, len(text)) // 4, 0

    return answer


EMBEDDERS["hashed"], PROVIDERS["stub"] = hashed, stub


def register(spark: SparkSession, embedder: str = "hashed", provider: str = "stub", embed: str = "plinth_embed", answer: str = "plinth_answer", **options) -> None:
    """Makes ``embed(text)`` (array<double>; null: as an empty text) and ``answer(TABLE(id, prompt))`` known to SQL. options: for the embedder.

    The table function gives (id, answer, prompt_tokens, answer_tokens, hit_tokens), a row for each of its rows; a prompt that a provider fails on
    has a null answer and the error's name in ``error``. Null prompts are asked as empty ones.
    """
    from ..shipping import ship

    ship(spark)
    make, ask = EMBEDDERS[embedder], PROVIDERS[provider]

    @pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(list(make(**options)(texts.fillna("").tolist())), dtype=object)

    @udtf(returnType="id long, answer string, prompt_tokens int, answer_tokens int, hit_tokens int, error string", useArrow=True)
    class Answers:
        def __init__(self):
            self.ask = ask()

        def eval(self, row):
            try:
                text, prompt, said, hit = self.ask(row["prompt"] or "")
            except Exception as e:  # one prompt doesn't stop the others
                yield row["id"], None, 0, 0, 0, type(e).__name__
            else:
                yield row["id"], text, prompt, said, hit, None

    spark.udf.register(embed, vectors)
    spark.udtf.register(answer, Answers)
