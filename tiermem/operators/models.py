"""Where models plug in: encoders, captioners and answerers as Arrow UDFs, with deterministic stand-ins that need no weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vector import cosine, let, mean, norm, normalised

DIM = 64


class Answerer(Protocol):
    """Takes rows with evidence text, question and options; gives them back with a string column prediction."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


def hashed_text_encoder(dim: int = DIM):
    """Stand-in text encoder: the words' hashed counts, L2-normalised; null or empty text has no vector."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import hashlib

        import numpy as np

        def one(said):
            if not said:
                return None
            v = np.zeros(dim)
            for w in said.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            return (v / (n if n else 1.0)).tolist()

        for batch in batches:
            yield batch.map(one)

    return encode


def model_encoder(load: Callable[[], Callable[[list], list]], returns: str = "array<double>", tolerant: bool = False):
    """An Arrow UDF around a model that load() builds once in each worker; the model maps a list of inputs to a list of outputs.
    tolerant: inputs on which it fails, tried one by one, give null, so that callers fall back; else a failure fails the job."""

    @F.pandas_udf(returns)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def safe(x):
            try:
                return model([x])[0]
            except Exception:  # whatever the model raises: the caller's fallback takes over
                return None

        for batch in batches:
            values = batch.tolist()
            try:
                out = model(values)
            except Exception:
                if not tolerant:
                    raise
                out = [safe(x) for x in values]
            yield pd.Series(out, index=batch.index, dtype=object)

    return encode


def chunk_pooled(vectors: Column) -> Column:
    """The vectors of a text's chunks to one: each over its own length, their mean, L2-normalised."""
    return normalised(mean(F.transform(vectors, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / n)))))


def chunked_text_vectors(ids: Column, encoder, size: int, bos: int, eos: int, pad: int) -> Column:
    """Token ids of a text to its vector: chunks of size ids between bos and eos, each encoded (encoder: a UDF from ids and mask to an array of vectors), pooled."""
    chunks = text.wrapped(text.chunked(ids, size), bos, eos, pad)
    return chunk_pooled(encoder(chunks["ids"], chunks["mask"]))


def encoded_frames(frames: DataFrame, encoder, n: int = 8) -> DataFrame:
    """Windows with n of their frames, evenly spread, encoded; a window without frames is an error."""
    sampled = text.uniform_sample(F.col("frames"), n)
    checked = F.when(F.size("frames") > 0, sampled).otherwise(F.raise_error(F.lit("a window has no frames")))
    return frames.withColumn("visual_embedding", encoder(checked))


def with_summary_embedding(rows: DataFrame, encoder=None) -> DataFrame:
    """summary_embedding where it is missing and there is a text; what the caller gave is kept. Without an encoder nothing changes.
    Rows that need the model are split off, so it never runs for the others."""
    if encoder is None:
        return rows
    need = F.col("summary_embedding").isNull() & (F.coalesce("summary_text", F.lit("")) != "")
    done = rows.where(need).withColumn("summary_embedding", encoder(F.col("summary_text")))
    return rows.where(~need).unionByName(done)


def captioned(rows: DataFrame, captioner=None, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """summary_text by the captioner over frame, or where there is none, no frame or no answer, by the template."""
    note = text.window_note(F.col(start), F.col(end))
    made = note if captioner is None else F.coalesce(F.nullif(F.when(F.col("frame").isNotNull(), captioner(F.col("frame"))), F.lit("")), note)
    return rows.withColumn("summary_text", made)


def fused_events(rows: DataFrame, fuser=None, summaries: str = "summaries", starts: str | None = None, ends: str | None = None, frames: str | None = None, max_frames: int = 8) -> DataFrame:
    """summary_text of events by a model over the request (and, where a column of frames is named, max_frames of them), or by the template where the
    model gives nothing, or no frame is there for one that takes frames; line breaks become spaces."""
    note = text.event_note(F.col(summaries), F.col("start_time"), F.col("end_time"))
    if fuser is None:
        return rows.withColumn("summary_text", note)
    request = fusion_prompt(F.col(summaries), starts and F.col(starts), ends and F.col(ends))
    if frames is None:
        said = fuser(request)
    else:
        seen = F.filter(F.col(frames), lambda f: f.isNotNull())
        said = F.when(F.size(seen) > 0, fuser(request, text.stride_sample(seen, max_frames)))
    return rows.withColumn("summary_text", F.coalesce(F.nullif(F.trim(F.regexp_replace(said, r"\s*\n\s*", " ")), F.lit("")), note))


#: Scenes of an event that a request tells of.
SCENES = 8


def scene_lines(summaries: Column, starts: Column | None = None, ends: Column | None = None) -> Column:
    """A numbered line for each of the first SCENES summaries, with its range where ranges are given."""
    one = lambda s, i: F.concat(F.lit("- Scene "), (i + 1).cast("string"), F.coalesce(F.concat(F.lit(" ["), text.fixed(F.get(starts, i), 1), F.lit("s–"), text.fixed(F.get(ends, i), 1), F.lit("s]")), F.lit("")) if starts is not None else F.lit(""), F.lit(": "), s)
    return F.array_join(F.transform(F.slice(summaries, 1, SCENES), one), "\n")


def fusion_prompt(summaries: Column, starts: Column | None = None, ends: Column | None = None) -> Column:
    """Our own request: a length that follows the number of scenes, and the scenes' lines."""
    n = F.least(F.size(summaries), F.lit(SCENES))
    length = F.when(n <= 1, "one sentence").when(n <= 3, "two sentences").otherwise("a short paragraph")
    return F.concat(F.lit("Tell in "), length, F.lit(" what happens over these scenes:\n"), scene_lines(summaries, starts, ends))


def with_frames(rows: DataFrame, slots: DataFrame, windows: DataFrame) -> DataFrame:
    """rows with frames: the pictures of each question's slots (evidence.frames, so a bounded number) in order; none is an empty array."""
    keys = ["stream_id", "question_id"]
    pictures = slots.join(windows.select("stream_id", "window_id", "frame"), ["stream_id", "window_id"])
    by = pictures.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slot", "frame")))["frame"].alias("frames"))
    return rows.join(by, keys, "left").withColumn("frames", F.coalesce("frames", F.expr("cast(array() as array<binary>)")))


def nearest_option(rows: DataFrame, encoder=None) -> DataFrame:
    """Stand-in answerer: the option whose encoded text is nearest to the evidence's, first on ties."""
    encoder = encoder or hashed_text_encoder()
    keys = ["stream_id", "question_id"]
    seen = rows.withColumn("evidence_vector", encoder(F.col("text")))
    each = seen.select(*keys, "evidence_vector", F.posexplode("options").alias("i", "option")).withColumn("v", encoder(F.col("option")))
    best = each.groupBy(*keys).agg(F.max(F.struct(F.coalesce(cosine(F.col("evidence_vector"), F.col("v")), F.lit(-1.0)).alias("s"), (-F.col("i")).alias("i"), "option")).alias("b"))
    return rows.join(best.select(*keys, F.col("b.option").alias("prediction")), keys, "left")


def answerer(kind: str = "nearest", **parts) -> Answerer:
    """The answerer of a kind: "nearest" is built in; "model" takes load, a function that builds a model from prompts to texts; "frames" takes load, a
    function that builds a model from pairs of prompt and list of pictures, and rows with a column frames (see with_frames)."""
    from .evidence import prompt

    if kind == "nearest":
        return lambda rows: nearest_option(rows, **parts)
    asked = prompt(F.col("text"), F.col("question"), F.col("options"))
    if kind == "model":
        model = model_encoder(parts["load"], "string")
        return lambda rows: rows.withColumn("prediction", model(asked))
    if kind == "frames":
        load = parts["load"]

        @F.pandas_udf("string")
        def seeing(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for prompts, pictures in batches:
                yield pd.Series(model(list(zip(prompts.tolist(), [list(p) for p in pictures], strict=True))), index=prompts.index, dtype=object)

        return lambda rows: rows.withColumn("prediction", seeing(asked, F.col("frames")))
    raise ValueError(f"no answerer of kind {kind}")
