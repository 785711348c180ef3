"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

A BPE encoding is right exactly if each two neighbouring tokens are what their joined
text encodes to. So the encoding of a prefix ends in the one vocabulary token whose
predecessor, the last token of a shorter prefix, goes with it. Storing that token for
every prefix gives the count at every prefix; counts are kept as differences from one
prefix to the next, one signed byte a code point, and answer truncation and budget
questions without encoding anything again.

Texts are cut into units where no vocabulary piece can reach across: before a space after
another character, around line feeds, and before punctuation that no piece has after a
letter or digit. A task remembers the differences of the units it met lately, within a number of bytes.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import Remembering, arrow_rows, once, schema_with

SPACE = "▁"
#: Bytes of units, and number of token pairs, that a task remembers at most (a matter of speed, not of results).
REMEMBERED, PAIRS = 96 << 20, 500_000


def load_pieces(path: str) -> dict[str, int]:
    """Text of each ordinary piece and its rank, with a plain space for the space mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.encode(" a") == model.encode("a"):
        raise ValueError("models that drop white space aren't covered")
    return {model.id_to_piece(i).replace(SPACE, " "): -model.get_score(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


def encode_short(text: str, ranks: dict[str, int]) -> list[str]:
    """Plain BPE over the characters of a short text: the best-ranked pair first, leftmost among equals."""
    parts = list(text)
    while True:
        best = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


class PrefixCounter(Remembering):
    """Unit of text to the differences between the token counts of its prefixes."""

    def __init__(self, ranks: dict[str, int]):
        super().__init__(REMEMBERED)
        if any("\n" in p or re.search(r"[^ ] ", p) for p in ranks):
            raise ValueError("units can't be cut at spaces and line feeds under this vocabulary")
        self.ranks = ranks
        self.tokens = {p for p in ranks if len(p) > 1 and encode_short(p, ranks) == [p]}
        self.pairs: dict[tuple[str, str], bool] = {}
        never = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") - {b for p in ranks for a, b in zip(p, p[1:], strict=False) if a.isalnum()}
        cut = f" *[^ \n]*?[^\\W_](?=[{re.escape(''.join(sorted(never)))}])|" if never else ""
        self.units = re.compile(cut + " *[^ \n]+|\n| +").findall
        #: By the last two characters of a token, the lengths of such tokens, longest first.
        lengths: dict[str, set[int]] = {}
        for p in self.tokens:
            lengths.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}

    def fits(self, pair: tuple[str, str]) -> bool:
        known = self.pairs[pair] = encode_short("".join(pair), self.ranks) == [*pair]
        return known

    def work_out(self, unit: str) -> bytes:
        counts, last = [0], [""]
        ranks, tokens, lengths, pairs = self.ranks, self.tokens, self.lengths, self.pairs
        for end in range(1, len(unit) + 1):
            for n in lengths.get(unit[max(0, end - 2) : end], ()):
                if n > end or (token := unit[end - n : end]) not in tokens:
                    continue
                if n < end and not (known if (known := pairs.get(pair := (last[end - n], token))) is not None else self.fits(pair)):
                    continue
                counts.append(counts[end - n] + 1)
                break
            else:
                token = unit[end - 1]  # a character of its own; without a piece it falls back to its bytes
                counts.append(counts[end - 1] + (1 if token in ranks else len(token.encode())))
            last.append(token)
        return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:], strict=False)])

    def __call__(self, text: str) -> np.ndarray:
        """Differences between the counts of the text's prefixes of 1, 2, ... code points; the first covers the leading space too."""
        if not text:
            return np.zeros(0, np.int8)
        self.age()
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        steps = np.frombuffer(b"".join(map(self.__getitem__, self.units(" " + text.replace(SPACE, " ")))), np.int8).copy()
        steps[1] += steps[0]
        return steps[1:]


def prefix_counts(df: DataFrame, model_path: str, text: str = "text", budgets: tuple[int, ...] = (), steps: str | None = None, n_tokens: str = "n_tokens") -> DataFrame:
    """Adds the token count; for each budget b fit_b, the code points of the longest prefix of at most b tokens; steps, if
    named, the stored differences (binary, a signed byte a code point), for tokens_at() and longest_fit().

    Null and empty texts have 0 tokens, fits of 0 and no differences. Texts of any length are counted whole, also a single unit of
    a whole text. Rows are independent: ties and repeated rows get the same counts each, an empty table gives an empty one. Clashing
    columns are replaced.
    """
    names = [n_tokens, *(f"fit_{b}" for b in budgets), *([steps] if steps else [])]
    kept = df.drop(*names)
    at, key, shared = kept.columns.index(text), uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def per_partition():
        counter = once("prefix counter", key, lambda: PrefixCounter(shared.value))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for x in batch.column(at).to_pylist():
                d = counter(x or "")
                total = d.sum(dtype=np.int64)
                row = [int(total)]
                for b in budgets:  # most texts fit whole
                    row.append(fit(d, b) if total > b else len(d))
                found.append(row + [d.tobytes()] * bool(steps))
            columns = list(zip(*found, strict=True))
            more = [pa.array(c, pa.binary() if steps and i == len(names) - 1 else pa.int64()) for i, c in enumerate(columns)]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

        return step

    return arrow_rows(kept, schema_with(kept, *(f"{n} {'binary' if n == steps else 'long'}" for n in names)), per_partition, "prefix counter")


def fit(steps: np.ndarray, budget: int) -> int:
    """The longest prefix within the budget; counts can fall as a prefix grows, so all prefixes are looked at."""
    within = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


@F.pandas_udf(LongType())
def tokens_at(steps, position):
    """Tokens of the prefix of so many code points, from stored differences; positions are held within the text."""
    import pandas as pd

    return pd.Series([None if s is None or p is None or p != p else int(np.frombuffer(s, np.int8)[: max(0, int(p))].sum(dtype=np.int64)) for s, p in zip(steps, position, strict=True)], dtype="Int64")


@F.pandas_udf(LongType())
def longest_fit(steps, budget):
    """Code points of the longest prefix within a budget of tokens, from stored differences."""
    import pandas as pd

    return pd.Series([None if s is None or b is None or b != b else fit(np.frombuffer(s, np.int8), int(b)) for s, b in zip(steps, budget, strict=True)], dtype="Int64")


#: Tokens beyond which a text counts as over the limit.
LIMIT = 4096


def op1_token_counts(spark, sf_dir):
    """doc_id, n_bytes, n_tokens, over_limit and fit_4096 of every document."""
    import public_tokenizers as public

    from .common import read, table

    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    # the count at every prefix is stored; questions of budgets are answered from there
    stored = table(prefix_counts(docs, public.path("piece_bpe_32k.model"), steps="steps").drop("text"), "token-counts")
    return stored.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), longest_fit("steps", F.lit(LIMIT)).alias(f"fit_{LIMIT}"))
