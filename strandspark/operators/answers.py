"""Answers and their evidence: prompt packing, cleaning, finalisation, generation metrics."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

# Messages and patterns that results must agree with.
UNSAFE_SETTINGS = r"(?i)\bdict\s*\(\s*settings\.config\s*\)|\breturn\s+settings\.config\b"
UNSAFE_SETTINGS_ANSWER = "The generated settings-dump example could expose sensitive values and has been withheld. Review the retrieved sources before using such code."
OMITTED_EXAMPLE = "[Unsafe settings-dump example omitted]"
NO_USABLE_ANSWER = "The retrieved evidence does not support a usable answer."
OPENING_ABSTENTION = (
    r"(?i)^(?:insufficient (?:retrieved )?evidence\b|(?:I|We) (?:cannot|can't|can not|am unable to|are unable to) (?:answer|determine|identify|provide)\b|"
    r"(?:The )?retrieved (?:evidence|excerpts) (?:is insufficient|do(?:es)? not (?:establish|contain|provide|support))\b|"
    r"There is (?:no|not enough|insufficient) evidence in the retrieved\b|Based on the retrieved excerpts, there is no explicit mention\b)"
)
LEAST_OVERLAP = 0.25
#: Blocks of an excerpt, whatever stands behind their closing fence; lines that may open or close a block of an answer; bullets without text.
EXCERPT_BLOCK = r"(?ms)^\s*```[^\n]*\n.*?^\s*```"
FENCE_LINE = r"^\s*(`{3,}|~{3,})"
EMPTY_BULLET = r"^\s*(?:[-+*]|\d+[.)])\s*(?:\[[ xX]\]\s*)?$"
# End of the fixed values.

_EXCERPT_BLOCK, _FENCE_LINE, _EMPTY_BULLET = map(re.compile, (EXCERPT_BLOCK, FENCE_LINE, EMPTY_BULLET))
_ONE_SPACE = re.compile(r"\s+")


def common_length(lengths: Column, fixed: Column, limit: int) -> Column:
    """The greatest excerpt length that lets all excerpts, each cut to it, fit with ``fixed`` tokens; null if none does.

    Tried are only the lengths at which an excerpt ends, and the even share beyond.
    """
    room = F.lit(limit) - fixed
    below = lambda n: F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + F.least(x, n))
    fits = F.coalesce(F.array_max(F.filter(lengths, lambda n: below(n) <= room)), F.lit(0))
    longer = F.size(F.filter(lengths, lambda x: x > fits))
    spare = F.when(longer > 0, F.floor((room - below(fits)) / F.greatest(longer, F.lit(1)))).otherwise(0)
    return F.when(room >= 0, (fits + spare).cast("int"))


def _blocks(lines: list[str]) -> dict[int, int | None]:
    """Where each block of an answer begins, and the line that closes it: only marks like the opening ones, at least as many; None if there is none."""
    marks = [(m[1][0], len(m[1]), not line[m.end() :].strip()) if (m := _FENCE_LINE.match(line)) else None for line in lines]
    found, behind = {}, 0
    for i, mark in enumerate(marks):
        if mark is not None and i >= behind:
            ends = (j for j in range(i + 1, len(lines)) if marks[j] and marks[j][0] == mark[0] and marks[j][1] >= mark[1] and marks[j][2])
            found[i] = next(ends, None)
            behind = (found[i] or i) + 1
    return found


@F.pandas_udf(T.StringType())
def cleaned(answers: pd.Series, evidence: pd.Series) -> pd.Series:
    """Without code that no excerpt contains, unclosed fences, and empty bullets; what follows an unclosed fence is text."""

    def clean(answer: str, excerpts) -> str:
        known = [_ONE_SPACE.sub(" ", x).strip() for x in (excerpts if excerpts is not None else []) if x]
        lines = answer.splitlines()
        blocks, kept, behind = _blocks(lines), [], 0
        for i, line in enumerate(lines):
            if i < behind:
                continue
            if i not in blocks:
                if not _EMPTY_BULLET.match(line):
                    kept.append(line.rstrip())
            elif blocks[i] is not None:
                behind = blocks[i] + 1
                code = _ONE_SPACE.sub(" ", "\n".join(lines[i + 1 : blocks[i]])).strip()
                if code and any(code in x for x in known):
                    kept += lines[i:behind]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip() or NO_USABLE_ANSWER

    return pd.Series([None if a is None else clean(a, e) for a, e in zip(answers, evidence, strict=True)])


def finalized(answer: Column, evidence: Column, marker: str, abstention: str) -> Column:
    """A marker or an opening abstention gives the standing answer, an unsafe example is withheld, else cleaned and masked."""
    bare = tx.strip(answer)
    opening = F.translate(F.regexp_replace(bare, r"^[\s*#>\-]+", ""), "’", "'")
    return F.when(bare.startswith(marker) | opening.rlike(OPENING_ABSTENTION), abstention).when(bare.rlike(UNSAFE_SETTINGS), UNSAFE_SETTINGS_ANSWER).otherwise(tx.redacted(cleaned(bare, evidence)))


@F.pandas_udf(T.StringType())
def without_unsafe_blocks(texts: pd.Series) -> pd.Series:
    """Fenced blocks that dump settings are replaced; used on masked excerpts."""
    unsafe = re.compile(UNSAFE_SETTINGS)
    return texts.map(lambda t: _EXCERPT_BLOCK.sub(lambda m: OMITTED_EXAMPLE if unsafe.search(m[0]) else m[0], t), na_action="ignore")


def safe_excerpt(x: Column) -> Column:
    return without_unsafe_blocks(tx.redacted(x))


def or_query(x: Column) -> Column:
    """A question's words with OR in between, for a web-search query."""
    return F.array_join(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""), " OR ")


@F.pandas_udf(T.StringType())
def safe_payload(payloads: pd.Series) -> pd.Series:
    """JSON text in which every excerpt and answer, at any depth, is masked; unsafe answers are withheld, all else stays."""
    unsafe = re.compile(UNSAFE_SETTINGS)
    rules = [(re.compile(pattern), re.sub(r"\$(\d)", r"\\\1", to)) for pattern, to in tx.REDACTIONS]

    def masked(text: str) -> str:
        for rule, to in rules:
            text = rule.sub(to, text)
        return _EXCERPT_BLOCK.sub(lambda m: OMITTED_EXAMPLE if unsafe.search(m[0]) else m[0], text)

    def safe(key: str | None, value):
        if isinstance(value, dict):
            return {k: safe(k, v) for k, v in value.items()}
        if isinstance(value, list):
            return [safe(None, v) for v in value]
        if isinstance(value, str) and key in ("answer", "excerpt", "chunk_text"):
            return UNSAFE_SETTINGS_ANSWER if key == "answer" and unsafe.search(value) else masked(value)
        return value

    return payloads.map(lambda p: json.dumps(safe(None, json.loads(p)), ensure_ascii=False), na_action="ignore")


def prompts(rows, limit: int, template: str, tokenizer: Callable[[], tuple], reserve: int = 0):
    """``rows`` (id, question, evidence) with messages, excerpts and truncated, for a token limit.

    ``evidence`` is an array of JSON objects with an excerpt each. All of them are kept,
    in order; if the whole message, roles included, has too many tokens, every excerpt is
    cut to the greatest common length that fits, and says whether it was cut. Nulls where
    even empty excerpts don't fit. ``template`` has the place {retrieved_chunks}.
    """

    def pack(frames):
        encode, _ = tokenizer()
        for frame in frames:
            out = []
            for row in frame.itertuples():
                items = [json.loads(e) for e in row.evidence]

                def written(size, question=row.question, items=items):
                    shown = items if size is None else [{**x, "excerpt": x["excerpt"][:size], "excerpt_truncated": len(x["excerpt"]) > size} for x in items]
                    return [{"role": "system", "content": template.replace("{retrieved_chunks}", json.dumps(shown, ensure_ascii=False))}, {"role": "user", "content": question}], [x["excerpt"] for x in shown]

                tokens = lambda *texts: sum(len(encode(x)) for x in texts)
                fixed = reserve + tokens("system", "user", row.question)  # alike for every trial length
                cost = lambda size, fixed=fixed: fixed + tokens(written(size)[0][0]["content"])  # noqa: E731, B023
                size = None
                if cost(None) > limit:
                    longest = max((len(x["excerpt"]) for x in items), default=0)
                    size = bisect.bisect_right(range(longest + 1), limit, key=cost) - 1
                messages, excerpts = written(size) if size is None or size >= 0 else (None, None)
                out.append((row.id, messages and json.dumps(messages, ensure_ascii=False), excerpts, size is not None))
            yield pd.DataFrame(out, columns=["id", "messages", "excerpts", "truncated"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "question", "evidence").mapInPandas(pack, f"id {kind}, messages string, excerpts array<string>, truncated boolean")


def answer_state(answer: Column, refused: Column) -> Column:
    return F.when(refused, "blocked").when(tx.is_abstention(answer), "abstained").when(F.size(tx.citations(answer)) > 0, "cited").otherwise("uncited")


def generation_metrics(answer: Column, chunks: Column, should_abstain: Column) -> Column:
    """Struct of abstained, appropriate, citations_valid and grounded.

    A claim is a sentence or line with two terms or more that isn't an abstention; it
    is supported if a chunk that it cites has a quarter of its terms.
    """
    n, abstained, numbers = F.size(chunks), tx.is_abstention(answer), tx.citations(answer)
    valid = F.forall(numbers, lambda r: (r >= 1) & (r <= n)) & (abstained | ((n > 0) & (F.size(numbers) > 0)))
    lines = F.split(answer, r"(?<=[.!?])\s+(?!\[\d+\])|\n+")
    claims = F.transform(lines, lambda x: F.struct(tx.content_terms(F.regexp_replace(x, r"\[\d+\]", "")).alias("terms"), tx.citations(x).alias("cited"), tx.is_abstention(F.regexp_replace(x, r"\[\d+\]", "")).alias("abstains")))
    scored = F.filter(claims, lambda c: (F.size(c["terms"]) >= 2) & ~c["abstains"])
    supported = lambda c: F.exists(c["cited"], lambda r: F.coalesce(tx.overlap(c["terms"], tx.content_terms(F.get(chunks, r - 1))) >= LEAST_OVERLAP, F.lit(False)))
    grounded = F.when(F.size(scored) > 0, F.forall(scored, supported)).otherwise(abstained)
    return F.struct(abstained.alias("abstained"), (abstained == should_abstain).alias("appropriate"), valid.alias("citations_valid"), grounded.alias("grounded"))
