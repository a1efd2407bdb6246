"""Token ids of every text of a corpus.

Every text of more than a segment (``tokenizer.SEGMENT_CHARS``) is encoded by tree concatenation: its
segments are encoded apart and neighbours are joined by windows that grow until both sides agree.  Texts of
up to ``SPREAD_CHARS`` characters go through the tree where they lie, without a shuffle; the parts of longer
ones are spread over the cluster, go through the tree in parallel, and are joined by the same rule in groups
of ``FAN_IN`` neighbours and then as a whole.

Edge cases: null and empty texts give an empty list; repeated rows give repeated rows; strings
that look like special tokens are ordinary text; lone surrogates cannot occur in a string column.
"""

from __future__ import annotations

from functools import partial
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizer import SEGMENT_CHARS, cut_points, piece_encoder, vocabulary_dir

#: Texts whose ids are held as lists at a time; characters of a part that is encoded in one task; parts joined at a time.
BATCH, SPREAD_CHARS, FAN_IN = 256, 1 << 20, 16


def _encode_batches(batches, ranks: str, lengths: bool, size: int):
    import numpy as np
    import pyarrow as pa

    encoder = piece_encoder(ranks)
    plain = encoder.encoding.encode_ordinary
    for batch in batches:
        texts = batch.column("text").fill_null("")
        counts, flat = [], []
        for at in range(0, len(texts), BATCH):
            ids = [plain(x) if len(x) <= size else encoder.encode_long(x, size) for x in texts.slice(at, BATCH).to_pylist()]
            counts += map(len, ids)
            if not lengths:
                flat.append(np.fromiter(chain.from_iterable(ids), np.int32))
        kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        if lengths:
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int32())], [*names, "n_tokens"])
        else:
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(offsets, values)], [*names, "ids"])


def _cut(frames, size: int):
    import pandas as pd

    for frame in frames:
        for doc, digest, text in frame.itertuples(index=False):
            cuts = cut_points(text, size)
            n = len(cuts) - 1
            yield pd.DataFrame({"doc_id": doc, "digest": digest, "n": range(n), "segment": [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]})


def _encode_parts(frames, ranks: str, size: int):
    encoder = piece_encoder(ranks)
    for frame in frames:
        yield frame.assign(ids=[encoder.encode_long(s, size) for s in frame["segment"]], copies=1)


def _join_parts(frame, ranks: str):
    """Neighbouring parts of one text as one; equal rows of a text are one text with a number of copies."""
    encoder = piece_encoder(ranks)
    frame = frame.sort_values("n", kind="stable")
    first = frame["n"].iloc[0]
    copies = int(frame.loc[frame["n"] == first, "copies"].sum())
    one = frame.drop_duplicates("n")
    text = "".join(one["segment"])
    cuts = [0, *one["segment"].str.len().cumsum()]
    ids = encoder.join_segments(text, cuts, [list(map(int, x)) for x in one["ids"]])
    return one.iloc[:1].assign(segment=text, ids=[ids], copies=copies)


def token_ids(documents: DataFrame, vocabulary: str | None = None, segment_chars: int = SEGMENT_CHARS, lengths: bool = False, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """``doc_id, ids`` of each document, or ``doc_id, n_tokens`` with ``lengths``."""
    folder = vocabulary or vocabulary_dir()
    ranks = f"{folder}/byte_bpe_50k.tiktoken"
    docs = documents.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    long = F.coalesce(F.length("text") > spread_chars, F.lit(False))
    out = f"doc_id {kind}, " + ("n_tokens int" if lengths else "ids array<int>")
    here = docs.where(~long).mapInArrow(partial(_encode_batches, ranks=ranks, lengths=lengths, size=segment_chars), out)
    parts = f"doc_id {kind}, digest bigint, n int, segment string, ids array<int>, copies int"
    joined = (
        docs.where(long)
        .select("doc_id", F.xxhash64("text").alias("digest"), "text")
        .mapInPandas(partial(_cut, size=spread_chars), f"doc_id {kind}, digest bigint, n int, segment string")
        .repartition("doc_id", "n")
        .mapInPandas(partial(_encode_parts, ranks=ranks, size=segment_chars), parts)
    )
    joined = joined.groupBy("doc_id", "digest", F.floor(F.col("n") / FAN_IN)).applyInPandas(lambda key, frame: _join_parts(frame, ranks), parts)
    joined = joined.groupBy("doc_id", "digest").applyInPandas(lambda key, frame: _join_parts(frame, ranks), parts)
    value = F.size("ids").alias("n_tokens") if lengths else F.col("ids")
    return here.unionByName(joined.select("doc_id", value, F.explode(F.sequence(F.lit(1), "copies"))).drop("col"))
