"""Token counts of whole texts, with huge texts encoded in overlapping chunks.

A text of more than `HUGE` characters is encoded chunk by chunk with offsets. Two neighbouring chunks are spliced at a
boundary that both have in their overlap and that is proven stable: before a space mark that follows another character,
which no piece of the vocabulary spans (this is read from the vocabulary). If the overlap holds no such boundary it is
widened, up to the whole text if need be, so that counts always equal those of the whole text.

Defined cases: null and empty texts have no tokens; special strings inside a text are ordinary text; repeated rows are
counted each; an empty table gives no rows; other columns are ignored.
"""

import functools

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from .store import narrow

LIMIT = 4096
HUGE, CHUNK, OVERLAP = 65_536, 32_768, 256
SPACES = (b" ", "▁".encode())


@functools.lru_cache(maxsize=2)
def tokenizer(model_path):
    """The model and whether a boundary before a space mark is stable: no piece has one after another character."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
    plain = "a  b ﬁ Å\n"
    same = model.decode(model.encode(plain)) == plain
    return model, same and not any("▁" in p.lstrip("▁") for p in pieces)


def _whole(data, at):
    """The nearest place at or before `at` where a character starts."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _starts(model, data, begin, end):
    """Where the tokens of a chunk start, as offsets of the whole text's bytes."""
    proto = model.encode(data[begin:end].decode(), return_type="proto")
    return np.fromiter((p.begin for p in proto.pieces), np.int64, len(proto.pieces)) + begin


def _stable(data, starts_a, starts_b, low, high):
    """The last stable boundary in [low, high) at which a token starts in both chunks, or None."""
    for p in np.intersect1d(starts_a, starts_b)[::-1].tolist():
        if low <= p < high and data.startswith(SPACES, p) and not data.endswith(SPACES, max(0, p - 3), p):
            return p
    return None


def count_huge(model, text, chunk=CHUNK, overlap=OVERLAP):
    data = text.encode()
    n, total, left, begin = len(data), 0, 0, 0
    end = _whole(data, min(n, chunk))
    starts = _starts(model, data, begin, end)
    while end < n:
        width = overlap
        while True:
            if width >= end - left:  # no boundary in the whole chunk: let it grow, then look again
                end = _whole(data, min(n, begin + 2 * (end - begin)))
                starts = _starts(model, data, begin, end)
                if end == n:
                    break
                width = overlap
                continue
            low = _whole(data, end - width)
            high = _whole(data, min(n, low + max(chunk, 2 * width)))
            following = _starts(model, data, low, high)
            at = _stable(data, starts, following, max(low, left) + 1, end)
            if at is not None:
                total += int(((starts >= left) & (starts < at)).sum())
                left, begin, end, starts = at, low, high, following
                break
            width *= 4
    return total + int((starts >= left).sum())


def count(model, splices, texts, huge=HUGE, chunk=CHUNK, overlap=OVERLAP):
    long = {i for i, t in enumerate(texts) if splices and len(t) > huge}
    rest = iter(model.encode([t for i, t in enumerate(texts) if i not in long], num_threads=1))
    return [count_huge(model, t, chunk, overlap) if i in long else len(next(rest)) for i, t in enumerate(texts)]


def token_counts(docs, model_path=None, limit=LIMIT, id_col="doc_id", text_col="text", slice_rows=64):
    """Per document: bytes, tokens and whether there are more than `limit` of them."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")

    def counted(batches):
        model, splices = tokenizer(model_path)
        for batch in batches:
            numbers = []
            for start in range(0, batch.num_rows, slice_rows):  # token lists of a few texts at a time
                texts = batch.column("text").slice(start, slice_rows).to_pylist()
                numbers += count(model, splices, [t or "" for t in texts])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"),
                                   "n_tokens": pa.array(numbers, pa.int64())})

    rows = narrow(docs, doc_id=id_col, text=text_col).withColumn(
        "n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
