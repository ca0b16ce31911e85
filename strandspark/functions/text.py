"""Text expressions: cleaning, rules, terms, citations, redaction. All are JVM-side columns, but for HTML entities."""

from __future__ import annotations

import html

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The rule patterns, words and messages that results must agree with.
FEATURE_SIGNALS = r"(?i)\b(?:featurerequest|feature request|request(?:ed)? support|support for|add support|implement(?:ation)?|new capability|would be useful to|please add|drop support|support\s+\d{3}|will \w+ support)\b"
BUG_SIGNALS = r"(?i)\b(?:bug|error|fail(?:s|ed|ure)?|crash(?:es|ed)?|regression|incorrect|unexpected|broken|does not work|not working|cannot|exception|traceback|fix(?:es|ed)?)\b"
USAGE_SIGNALS = r"(?i)\b(?:question about|how (?:do|does|can|should|to)|how about|when using|usage|example|clarification|what is the (?:correct )?(?:way|usage)|required, can be none)\b"
ABSTENTION = r"(?i)\b(?:insufficient evidence|evidence is insufficient|evidence does not (?:provide|support|contain)|cannot (?:answer|determine|provide)|can't (?:answer|determine)|not enough evidence|unable to answer|do not have enough)\b"
STOP_WORDS = (
    "about", "after", "also", "and", "are", "because", "before", "from", "into", "issue", "more", "only",
    "reported", "that", "the", "their", "then", "this", "through", "using", "what", "when", "with",
)
REDACTED = "[REDACTED]"
SECRET_NAMES = "JWT_SECRET|SECRET_KEY|API_KEY|PASSWORD|ACCESS_TOKEN"
#: Patterns of secrets and what replaces them, in the order of use.
REDACTIONS = (
    (r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", REDACTED),
    (r"(?i)(\b(?:[a-z0-9_]*(?:password|passwd|secret|api_key|access_token|refresh_token|private_key|authorization)[a-z0-9_]*|token)\b[\"']?\s*[:=]\s*(?:Secret\s*\(\s*)?)([\"'])[^\r\n]*?\2", rf"$1$2{REDACTED}$2"),
    (r"(?i)(\bBearer\s+)[a-z0-9._~+/=-]+", rf"$1{REDACTED}"),
    (r"\b(?:sk-[a-zA-Z0-9_-]{16,}|(?:AKIA|ASIA)[A-Z0-9]{16})\b", REDACTED),
    (r"\beyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\b", REDACTED),
    (r"(?i)([a-z][a-z0-9+.-]*://)[^\s/@:]+:[^\s/@]+@", rf"$1{REDACTED}@"),
    # a look-up, None or a mask isn't a literal value
    (rf"(?im)(\b(?:{SECRET_NAMES})\s*=\s*)(?!(?-i:config\(|Secret\(|os\.|getenv\(|None\b|\[REDACTED\]))[^\s\"'\n][^\n]*", rf"$1{REDACTED}"),
    (rf"(?im)^(\s*(?:{SECRET_NAMES})\s*:\s*)[^\s\"'\n][^\n]*", rf"$1{REDACTED}"),
)
# End of the fixed values.


def _plain(texts: pa.Array) -> pa.Array:
    """Entities to characters; texts without an ampersand aren't touched."""
    some = pc.fill_null(pc.match_substring(texts, "&"), False)
    return pc.replace_with_mask(texts, some, pa.array([html.unescape(t) for t in texts.filter(some).to_pylist()], texts.type))


@F.arrow_udf(T.StringType())
def html_unescape(texts: pa.Array) -> pa.Array:
    """HTML entities to characters; Spark has no such function."""
    return _plain(texts)


@F.arrow_udf(T.ArrayType(T.StringType()))
def unescaped(texts: pa.Array) -> pa.Array:
    """The same for all texts of a row at once."""
    return pa.ListArray.from_arrays(texts.offsets, _plain(texts.values), mask=texts.is_null()) if texts.null_count else pa.ListArray.from_arrays(texts.offsets, _plain(texts.values))


#: White space of any script, the separators U+001C to U+001F included.
WHITE_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(x: Column) -> Column:
    """Without white space of any script at both ends; Spark's trim knows the space only."""
    return F.btrim(x, F.lit(WHITE_SPACE))


def normal_title(x: Column) -> Column:
    return strip(F.regexp_replace(F.translate(x, "\0", ""), r"(?U)[\s\x1C-\x1F]+", " "))


def normal_body(x: Column) -> Column:
    return strip(F.translate(F.regexp_replace(x, r"\r\n?", "\n"), "\0", ""))


def redacted(x: Column) -> Column:
    """Literal secrets masked, by all rules in order."""
    for pattern, to in REDACTIONS:
        x = F.regexp_replace(x, pattern, to)
    return x


def rule_label(title: Column, body: Column) -> Column:
    """Struct of label and confidence: a signal in the title decides, else the signal found most often, if only one is.

    The counts are the elements of an array that a lambda gets, so each text is searched
    once for each kind of signal.
    """
    kinds = ("bug", "feature", "usage")
    title = F.coalesce(title, F.lit(""))
    text = F.concat_ws("\n", title, F.coalesce(body, F.lit("")))
    counts = F.array(*[F.regexp_count(text, F.lit(p)) for p in (BUG_SIGNALS, FEATURE_SIGNALS, USAGE_SIGNALS)])
    in_title = F.when(title.rlike(FEATURE_SIGNALS), "feature").when(title.rlike(BUG_SIGNALS), "bug").when(title.rlike(USAGE_SIGNALS), "usage")

    def decided(found: Column) -> Column:
        n, by_title = found["n"], found["by_title"]
        most = F.array_max(n)
        alone = F.size(F.filter(n, lambda x: x == most)) == 1
        by_count = F.when((most > 0) & alone, F.element_at(F.array(*map(F.lit, kinds)), F.array_position(n, most).cast("int")))
        confidence = F.when(by_title.isNotNull(), "high").when(by_count.isNotNull() & (most >= 2), "medium").otherwise("low")
        return F.struct(F.coalesce(by_title, by_count, F.lit("unknown")).alias("label"), confidence.alias("confidence"))

    return F.get(F.transform(F.array(F.struct(counts.alias("n"), in_title.alias("by_title"))), decided), F.lit(0))


def is_abstention(answer: Column) -> Column:
    return F.coalesce(answer.rlike(ABSTENTION), F.lit(False))


def content_terms(x: Column) -> Column:
    """Distinct lower-case terms of three characters or more, without stop words."""
    terms = F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit("(?i)([a-z0-9_]{3,})")), F.lower))
    return F.array_except(terms, F.array(*map(F.lit, STOP_WORDS)))


def citations(answer: Column) -> Column:
    """Numbers in brackets that are neither images, escaped, nor links."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"(?<![!\\])\[(\d+)\](?!\s*\()")), lambda x: x.cast("int"))


def overlap(claim: Column, evidence: Column) -> Column:
    """Share of the claim's terms that the evidence has; null for a claim without terms."""
    return F.try_divide(F.size(F.array_intersect(claim, evidence)), F.size(claim))
