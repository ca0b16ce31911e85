"""Structure-aware chunks: fenced blocks and paragraphs, packed up to a token limit with overlap."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identity import uuid5
from ..functions.text import strip

# What chunks and their ids must agree with.
CHUNK_NAMESPACE = uuid.UUID("816415d9-0263-4ba5-b33a-8f786794bd5e")
#: A fenced block from its opening line to the next closing one, of either kind, without the line's end.
FENCE = r"(?ms)^[ \t]*(?:```|~~~)[^\n]*\n.*?^[ \t]*(?:```|~~~)[ \t]*$"
#: A paragraph ends after an empty line.
PARAGRAPH_END = r"(?<=\n\n)"
UNTITLED = "(untitled issue)"
RESOLUTION_NOTE = "[Low-confidence heuristic resolution; not ground truth. Stored confidence: %s]\n%s"
# End of the fixed values.

_FENCE, _PARAGRAPH_END, _WORD = re.compile(FENCE), re.compile(PARAGRAPH_END), re.compile(r"\s*\S+|\s+\Z")
#: Texts that are cut at a time.
TEXTS = 64
#: From a text to its tokens, and from tokens to a text.
Tokenizer = tuple[Callable[[str], list], Callable[[list], str]]


def words() -> Tokenizer:
    """Words with the white space before them."""
    return _WORD.findall, "".join


def ranked_tokens(ranks_path: str, pattern: str) -> Callable[[], Tokenizer]:
    """A byte-level BPE tokenizer from a file of base64 tokens and ranks, built where it is used."""

    def build() -> Tokenizer:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return encoding.encode_ordinary, encoding.decode

    return build


def atoms(text: str) -> Iterator[str]:
    """Fenced blocks whole; other text by paragraphs, separators kept."""
    at = 0
    for block in [*_FENCE.finditer(text), None]:
        plain = text[at : block.start()] if block else text[at:]
        yield from filter(None, _PARAGRAPH_END.split(plain))
        if block:
            yield block[0]
            at = block.end()


def windows(atom: str, size: int, overlap: int, tokenizer: Tokenizer) -> Iterator[str]:
    """The atom, or windows of ``size`` tokens of a longer one, each beginning with the end of the one before."""
    encode, decode = tokenizer
    tokens = encode(atom)
    if len(tokens) <= size:
        yield atom
    else:
        yield from (decode(tokens[k : k + size]) for k in range(0, len(tokens) - overlap, size - overlap))


def packed(text: str, size: int, overlap: int, tokenizer: Tokenizer) -> Iterator[tuple[str, int]]:
    """Chunks and their number of tokens.

    What doesn't fit opens a chunk, after the end of the last one: ``overlap`` tokens,
    or as many as leave room.
    """
    encode, decode = tokenizer
    held = ""
    for part in (w for atom in atoms(text) for w in windows(atom, size, overlap, tokenizer)):
        joined = held + part
        if held and len(encode(joined)) > size:
            tokens = encode(held)
            yield held, len(tokens)
            room = min(overlap, size - len(encode(part)))
            joined = decode(tokens[-room:]) + part if room > 0 else part
        held = joined
    if held.strip():
        yield held, len(encode(held))


def chunked(sources: DataFrame, size: int = 700, overlap: int = 100, tokenizer: Callable[[], Tokenizer] = words) -> DataFrame:
    """The other columns of ``sources``, and for each chunk of its text piece (from 0), chunk and n_tokens; null and blank texts have none."""
    keys = [c for c in sources.columns if c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sources.schema.fields if f.name != "text"), "piece int, chunk string, n_tokens int"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokenizer()
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):  # a few texts and their chunks at a time
                part, rows, pieces, chunks, counts = batch.slice(k, TEXTS), [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    for piece, (chunk, n) in enumerate(packed(text or "", size, overlap, made)):
                        rows.append(i), pieces.append(piece), chunks.append(chunk), counts.append(n)
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in keys), pa.array(pieces, pa.int32()), pa.array(chunks, pa.string()), pa.array(counts, pa.int32())], [*keys, "piece", "chunk", "n_tokens"])

    return sources.select(*keys, F.col("text").cast("string")).mapInArrow(cut, schema)


def thread_sources(threads: DataFrame) -> DataFrame:
    """A row for each text of a thread that isn't blank: its body, its comments in order, its resolution.

    ``threads`` has repository, issue_number, title, body, comments (of body and
    html_url), resolution_text, resolution_confidence, github_url and content_hash.
    """
    said = lambda x: strip(F.coalesce(x, F.lit(""))) != ""
    source = lambda kind, at, text, url: F.struct(F.lit(kind).alias("chunk_type"), at.cast("int").alias("at"), text.alias("said"), url.alias("source_url"))
    url = F.col("github_url")
    comments = F.transform(F.coalesce("comments", F.array().cast(threads.schema["comments"].dataType)), lambda c, i: source("comment", i, c["body"], F.coalesce(F.nullif(c["html_url"], F.lit("")), url)))
    note = F.printf(F.lit(RESOLUTION_NOTE), F.coalesce(F.nullif("resolution_confidence", F.lit("")), F.lit("unspecified")), F.col("resolution_text"))
    resolution = F.when(said(F.col("resolution_text")), note)
    every = F.concat(F.array(source("issue_body", F.lit(0), F.col("body"), url)), comments, F.array(source("heuristic_resolution", F.lit(0), resolution, url)))
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED))
    prefix = F.concat(F.lit("Repository: "), F.col("repository"), F.lit("\nIssue: #"), F.col("issue_number").cast("string"), F.lit("\nTitle: "), title, F.lit("\n\n"))
    rows = threads.select("repository", F.col("issue_number").cast("long").alias("issue_number"), "content_hash", prefix.alias("prefix"), F.explode(F.filter(every, lambda x: said(x["said"]))).alias("x"))
    return rows.select("repository", "issue_number", "content_hash", "x.chunk_type", "x.at", "x.source_url", F.concat("prefix", strip(F.col("x.said"))).alias("text"))


def thread_chunks(threads: DataFrame, size: int = 700, overlap: int = 100, tokenizer: Callable[[], Tokenizer] = words) -> DataFrame:
    """Chunks of all texts of each thread, numbered through by type, with ids that follow from repository, number, type and index."""
    key = ["repository", "issue_number", "chunk_type"]
    chunks = chunked(thread_sources(threads), size, overlap, tokenizer)
    index = F.row_number().over(Window.partitionBy(*key).orderBy("at", "piece")) - 1  # the chunks of one thread
    chunks = chunks.withColumn("chunk_index", index)
    name = F.concat_ws("\0", "repository", F.col("issue_number").cast("string"), "chunk_type", F.col("chunk_index").cast("string"))
    return chunks.select(uuid5(CHUNK_NAMESPACE, name).alias("chunk_id"), *key, "chunk_index", F.col("chunk").alias("chunk_text"), "source_url", "content_hash", "n_tokens")
