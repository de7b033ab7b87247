"""Small hand-made documents with the awkward cases, and helpers of the tests."""

from __future__ import annotations

import random

from pyspark.sql.types import StructType

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def texts() -> list[str | None]:
    """Null, empty, blank, short, long, repeated and near-equal texts, and odd characters."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def prose(n: int) -> list[str]:
        return [rng.choice(vocabulary) for _ in range(n)]

    base = prose(120)
    near = [*base[:60], "changed", *base[61:]]
    far = [*base[:30], *prose(90)]
    out = [None, "", " ", "\n\t \n", "one", "Two words", "two Words", " ".join(base), " ".join(base)]
    out += [" ".join(near), " ".join(far), " ".join(base).upper(), "\n".join(base), " ".join(prose(9000))]
    out += ["x" * 5000, "a" * 3000 + " " + "ab" * 2000, "İstanbul ΣΑΣ ΟΔΟΣ é́ \u00a0 日本語 😀👍🏽 don't I'LL we’ve \x1c z\x85q"]
    out += ["<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|> c", "tab\tand\r\nlines  two\n\n\nthree "]
    out += ["Licensed under CC BY-NC 4.0. All rights reserved.", "cc by cc by", "GNU General Public License, version 3."]
    out += ["same line\nsame line\nother line\nsame line", " ".join(["again and"] * 40), "$$$ ### %%% |&| " * 20]
    out += [" ".join(prose(rng.randint(20, 400))) for _ in range(30)]
    return out


def rows() -> list[tuple]:
    made = [
        (i, t, None if i % 7 == 3 else ("en", "de")[i % 2], f"src{i % 3}", len(t or ""), "clash")
        for i, t in enumerate(texts())
    ]
    return made + [made[7]]  # one row stands there twice


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark, schema: str = SCHEMA):
    return spark.createDataFrame([], StructType.fromDDL(schema))


def labels(spark, some=None):
    data = some if some is not None else [(r[0], 0 if "$$$" in (r[1] or "") else 1, 0) for r in rows()]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


class CountedLooks(dict):
    """A memory of known pieces that counts how often it is asked."""

    looks = 0

    def get(self, *args):
        self.looks += 1
        return super().get(*args)

    def __getitem__(self, key):
        self.looks += 1
        return super().__getitem__(key)

    def __contains__(self, key):
        self.looks += 1
        return super().__contains__(key)
