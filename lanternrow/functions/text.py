"""Text functions over columns. Null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wordings that count as a refusal to answer.
REFUSAL = (
    r"(?i)\bNOT_STATED\b|\bnot (?:stated|specified|mentioned|provided|available|found|contained)\b"
    r"|\bcannot be determined\b|\bno information\b|\bdoes not (?:state|specify|mention|contain)\b"
)


def fold(s: Column) -> Column:
    """Lower case with ß as ss, as near as built-ins get to case folding (U+017F, U+03C2 and U+0131 stay)."""
    return F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))


def tokens(s: Column) -> Column:
    """Runs of letters, digits and underscore of the folded text."""
    return F.regexp_extract_all(fold(s), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def words(s: Column) -> Column:
    """Non-empty parts between white space."""
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def collapse(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+", " ")


def snippet(s: Column, n: int = 300) -> Column:
    """The first n characters with white space collapsed."""
    return F.substring(F.trim(collapse(s)), 1, n)


def slug(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), F.lit("-"))


def extract_final(s: Column) -> Column:
    """The first line after the last ANSWER:, else the last line that isn't blank, else empty."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    tail = strip(F.substring_index(s, "ANSWER:", -1))
    lines = F.filter(F.transform(F.split(s, r"\r\n|[\n\r]"), strip), lambda x: x != "")
    last = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    return F.when(F.contains(s, F.lit("ANSWER:")), strip(F.get(F.split(tail, r"\r\n|[\n\r]"), F.lit(0)))).otherwise(last)


def is_refusal(s: Column) -> Column:
    return s.rlike(REFUSAL)


def norm_text(s: Column) -> Column:
    """Folded, white space collapsed, without spaces and .,;: at the ends."""
    return F.trim(collapse(fold(s)), F.lit(" .,;:"))


def norm_quote(s: Column) -> Column:
    """norm for quotes: soft hyphens out, straight quotes, words broken over lines joined, folded, collapsed."""
    s = F.replace(s, F.lit("­"), F.lit(""))
    s = F.translate(s, "‘’“”", "''\"\"")
    s = F.regexp_replace(s, r"-\s*\n\s*", "")
    return F.trim(collapse(fold(s)))


def quote_on_page_exact(quote: Column, page: Column) -> Column:
    """A quote of three words or more that stands on the page after norm_quote."""
    return (F.size(words(quote)) >= 3) & F.contains(norm_quote(page), norm_quote(quote))


def has_table(s: Column) -> Column:
    """A markdown header row followed by a rule row."""
    return s.rlike(r"(?m)^\s*\|.*\|\s*\n\s*\|[\s:|-]+\|\s*$")


def overlap(query: Column, doc: Column) -> Column:
    """Share of the query's different tokens that the document has."""
    q = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(q, tokens(doc))) / F.greatest(F.size(q), F.lit(1))


def parse_evidence(s: Column) -> Column:
    """'doc:3, other:5' as an array of (doc_id, page); the last colon splits."""
    parts = F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, "^(.*):", 1).alias("doc_id"), F.regexp_extract(x, r":\s*(\d+)$", 1).try_cast("int").alias("page")))


def parse_json(s: Column, schema: str) -> Column:
    """The first JSON object in a reply, code fences and trailing prose aside; null if there is none."""
    bare = F.regexp_replace(s, r"```(?:json)?", "")
    at = F.instr(bare, "{")
    return F.when(at > 0, F.from_json(F.substr(bare, at), schema))


def human_date(d: Column) -> Column:
    return F.date_format(d, "d MMMM yyyy")


def render_pages(pages: Column, most: int = 1500) -> Column:
    """An array of (page, text) as '[page n]' blocks of the first `most` words, in page order."""
    one = lambda p: F.concat(F.lit("[page "), p["page"].cast("string"), F.lit("]\n"), F.array_join(F.slice(words(p["text"]), 1, most), " "))
    return F.array_join(F.transform(F.array_sort(pages), one), "\n\n")


def sse_usage(stream: Column) -> Column:
    """(prompt_tokens, completion_tokens, finish) of a server-sent event text: the last of each that is given."""
    schema = "usage struct<prompt_tokens: bigint, completion_tokens: bigint>, choices array<struct<finish_reason: string>>"
    lines = F.filter(F.split(stream, r"\r?\n"), lambda x: x.startswith("data:"))
    data = F.filter(F.transform(lines, lambda x: F.trim(F.substring(x, 6, 1 << 30))), lambda x: x != "[DONE]")
    parsed = F.transform(data, lambda x: F.from_json(x, schema))
    usage = F.try_element_at(F.filter(parsed, lambda x: x["usage"].isNotNull()), F.lit(-1))["usage"]
    finish = F.try_element_at(F.filter(F.transform(parsed, lambda x: F.get(x["choices"], F.lit(0))["finish_reason"]), lambda x: x.isNotNull()), F.lit(-1))
    return F.struct(usage["prompt_tokens"].alias("prompt_tokens"), usage["completion_tokens"].alias("completion_tokens"), finish.alias("finish"))


def expand(template: str, query: Column, document: Column) -> Column:
    """The template with {query} and {document} put in as they stand: braces in either survive."""
    parts = re.split(r"(\{query\}|\{document\})", template)
    return F.concat(*({"{query}": query, "{document}": document}.get(p, F.lit(p)) for p in parts))


def gold_text(kind: Column, value: Column, values: Column) -> Column:
    return F.when(kind == "unanswerable", F.lit("The documents do not state this.")).when(values.isNotNull(), F.array_join(values, "; ")).otherwise(value)
