"""Token counts of whole texts, without keeping the ids.

Arrow functions encode batches and return lengths only. Texts are dealt into batches
of about equal bytes, and a long text is cut at places where no piece of the
vocabulary can reach across, so that the parts' counts add up to the whole's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, tokenizer_path

BATCH_BYTES = 256 << 10
PART_CHARS = 16 << 10
META = "▁"
_loaded: dict[str, tuple[Callable[[list[str]], list[int]], bool]] = {}


def _sentencepiece(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    # a cut before a single space is safe if no piece holds the space mark after
    # another character, and the library puts the mark before each text as written
    inside = any(META in p.lstrip(META) for p in pieces)
    plain = model.encode(" a  b ", out_type=str) and "".join(model.encode("a  b", out_type=str)) == f"{META}a{META}{META}b"
    return (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), plain and not inside


def _tokenizers(path: str):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return (lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]), False


def counter(path: str):
    """(count of a list of texts, whether texts may be cut before single spaces)."""
    if path not in _loaded:
        _loaded[path] = (_sentencepiece if path.endswith(".model") else _tokenizers)(path)
    return _loaded[path]


def safe_parts(text: str, most: int = PART_CHARS) -> list[str]:
    """Cut ``text`` at single spaces between other characters, a part over ``most``
    characters only where it holds no such space. The space itself goes: the library
    puts its mark before every part."""
    parts, at, n = [], 0, len(text)
    while n - at > most:
        cut = at + most
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= n:
                parts.append(text[at:])
                return parts
            if text[cut - 1] not in (" ", META) and text[cut + 1] not in (" ", META):
                break
            cut += 1
        parts.append(text[at:cut])
        at = cut + 1
    parts.append(text[at:])
    return parts


def lengths(texts: list[str], path: str, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """Token counts of ``texts``, encoded in batches of about ``batch_bytes`` bytes."""
    count, cuts = counter(path)
    totals = [0] * len(texts)
    owners: list[int] = []
    batch: list[str] = []
    size = 0

    def flush() -> None:
        for owner, n in zip(owners, count(batch), strict=True):
            totals[owner] += n

    for i, text in enumerate(texts):
        for part in safe_parts(text) if cuts and len(text) > PART_CHARS else (text,):
            if not part:
                continue
            owners.append(i)
            batch.append(part)
            size += len(part) if part.isascii() else len(part.encode())
            if size >= batch_bytes:
                flush()
                owners, batch, size = [], [], 0
    if batch:
        flush()
    return totals


def length_udf(path: str):
    def token_lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(lengths([t or "" for t in texts.to_pylist()], path), pa.int64())

    return F.arrow_udf(token_lengths, "long")


def count_tokens(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, one row for each input row.

    A null text counts as empty: 0 bytes and 0 tokens. Texts of any length are encoded
    whole. Repeated rows give repeated results, an empty table an empty one; other
    columns are ignored, whatever their names.
    """
    counted = length_udf(tokenizer_path(tokenizer))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), counted("text").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
