"""Adapters for chat, embedding and rerank services: batched per Arrow batch, retried inside the task, errors as rows.

A service is any callable; the ones here need no network and stand in for real ones in tests.
"""

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

ANSWER = "text string, input_tokens long, output_tokens long, latency_s double, finish_reason string, error string"


def mock_chat(prompt: str) -> dict:
    """The prompt's last line as the answer; tokens are words."""
    lines = [x.strip() for x in prompt.splitlines() if x.strip()]
    text = f"ANSWER: {lines[-1]}" if lines else ""
    return {"text": text, "input_tokens": len(prompt.split()), "output_tokens": len(text.split()), "finish_reason": "stop"}


def complete(prompts: DataFrame, key: str = "qid", prompt: str = "prompt", service: Callable[[str], dict] = mock_chat, tries: int = 3, wait: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """key and the answer's fields, and the columns of `keep` as they are; with `keep`, rows without a prompt pass by without a call. A call is tried again with doubled waits; what still fails is a row with error set. Refused stops the job.

    Write the result before using it twice: a plan that is run again calls the service again.
    """
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for at, (k, p) in enumerate(zip(pdf[key], pdf[prompt], strict=True)):
                row: dict = {key: k} | {c: pdf[c].iloc[at] for c in keep} | {"text": None, "input_tokens": None, "output_tokens": None, "latency_s": None, "finish_reason": None, "error": None}
                for n in range(0 if keep and p is None else tries):
                    began = time.time()
                    try:
                        row |= service(p or "") | {"error": None, "latency_s": time.time() - began}
                        break
                    except Refused:
                        raise
                    except Exception as e:  # noqa: BLE001  the service's errors are results
                        row["error"] = f"{type(e).__name__}: {e}"
                        if n + 1 < tries:
                            time.sleep(min(30.0, wait * 2**n))
                out.append(row)
            yield pd.DataFrame(out, columns=[key, *keep, "text", "input_tokens", "output_tokens", "latency_s", "finish_reason", "error"]).astype({"text": object, "input_tokens": "Int64", "output_tokens": "Int64", "latency_s": "Float64", "finish_reason": object, "error": object})

    types = dict(prompts.dtypes)
    return prompts.select(key, prompt, *keep).mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in (key, *keep)) + f", {ANSWER}")


def fuzzy_quotes(rows: DataFrame, quote: str = "quote", page: str = "page", least: float = 0.9) -> DataFrame:
    """rows with on_page: a quote of three words or more stands on the page, or characters of the page that match it in order
    make up `least` of it and lie within 1.5 times its length. Only quotes that the page has the letters for are aligned."""
    import pandas as pd
    from pyspark.sql import functions as F

    from ..functions.text import norm_quote, quote_on_page_exact, words

    def covers(text: str, wanted: str) -> bool:
        from collections import Counter
        from difflib import SequenceMatcher

        need = least * len(wanted)
        if (Counter(wanted) & Counter(text)).total() < need:
            return False
        # the page comes first: the alignment isn't symmetric
        spans = [(m.a, m.a + m.size) for m in SequenceMatcher(a=text, b=wanted, autojunk=False).get_matching_blocks() if m.size]
        return bool(spans) and sum(e - s for s, e in spans) >= need and spans[-1][1] - spans[0][0] <= 1.5 * len(wanted)

    @F.pandas_udf("boolean")
    def near(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([bool(w) and t is not None and covers(t, w) for t, w in zip(texts, wanted, strict=True)], dtype=bool)

    exact = F.coalesce(quote_on_page_exact(F.col(quote), F.col(page)), F.lit(False))
    open_ = F.when(~exact & (F.size(words(F.col(quote))) >= 3), norm_quote(F.col(quote)))
    return rows.withColumn("on_page", exact | near(norm_quote(F.col(page)), open_))


def best_page(evidence: DataFrame, pages: DataFrame, reach: int = 2) -> DataFrame:
    """doc_id, mapped, page, ratio: of the pages within `reach` of a mapped page the one most like its text, the first of equals.

    Texts are compared folded and with white space collapsed.
    """
    import pandas as pd
    from pyspark.sql import functions as F

    from ..functions.text import collapse, fold
    from ..storage import written

    @F.pandas_udf("page int, ratio double")
    def closest(texts: pd.Series, near: pd.Series) -> pd.DataFrame:
        from difflib import SequenceMatcher

        out = []
        for text, pages_ in zip(texts, near, strict=True):
            best, page = -1.0, None
            # quick_ratio is never below ratio, so pages that can't be the best are not aligned
            tries = [(m.quick_ratio(), -p["page"], m) for p in pages_ for m in [SequenceMatcher(None, text, p["text"], autojunk=False)]]
            for most, less, m in sorted(tries, key=lambda t: t[:2], reverse=True):
                if most < best:
                    break
                best, page = max((best, page), (m.ratio(), less)) if page is not None else (m.ratio(), less)
            out.append((-page, best))
        return pd.DataFrame(out, columns=["page", "ratio"])

    plain = lambda c: F.coalesce(F.trim(collapse(fold(F.col(c)))), F.lit(""))
    around = F.explode(F.sequence(F.col("mapped") - reach, F.col("mapped") + reach)).alias("page")
    wanted = evidence.select("doc_id", "mapped", plain("text").alias("text"))
    digest = F.sha2(F.col("text"), 256).alias("h")
    shown = pages.select("doc_id", "page", plain("text").alias("text"))
    # a ratio is 1 where texts are equal and nowhere else, so those are met by their digests
    met = wanted.select("doc_id", "mapped", digest, around).join(shown.select("doc_id", "page", digest), ["doc_id", "page", "h"])
    same = written(met.groupBy("doc_id", "mapped").agg(F.min("page").alias("page")), "equal-pages")
    rest = wanted.join(same, ["doc_id", "mapped"], "left_anti").select("doc_id", "mapped", "text", digest, around)
    near = rest.join(shown.withColumnRenamed("text", "t"), ["doc_id", "page"]).groupBy("doc_id", "mapped", "h").agg(F.first("text").alias("text"), F.collect_set(F.struct("page", F.col("t").alias("text"))).alias("near"))
    rows = near.select("doc_id", "mapped", closest("text", "near").alias("r"))
    found = rows.groupBy("doc_id", "mapped").agg(F.max_by("r", F.struct("r.ratio", -F.col("r.page"))).alias("r"))
    return same.select("doc_id", "mapped", "page", F.lit(1.0).alias("ratio")).unionByName(found.select("doc_id", "mapped", "r.page", "r.ratio"))


class Refused(Exception):
    """A request that the service will never take: not tried again and not made a row, the job stops."""


def mock_embed(texts: list[str]) -> dict:
    """Vectors of (bytes, spaces, 1), the last first, with their index; tokens are words."""
    data = [{"index": i, "embedding": [float(len(t.encode())), float(t.count(" ")), 1.0]} for i, t in enumerate(texts)]
    return {"data": data[::-1], "prompt_tokens": sum(len(t.split()) for t in texts)}


def embed(texts: DataFrame, key: str, text: str = "text", service: Callable[[list[str]], dict] = mock_embed, size: int = 64) -> DataFrame:
    """key, embedding of unit length (a zero vector stays), input_tokens. Texts go in requests of `size`; answers are put back by their index.

    A request's tokens stand on its first row and the others have 0, so that their sum is what was used. Null texts are empty.
    """
    import numpy as np
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                asked = [t or "" for t in part[text]]
                answer = service(asked)
                if sorted(d["index"] for d in answer["data"]) != list(range(len(asked))):
                    raise ValueError(f"{len(asked)} texts were sent, but the answer's indices are others")
                x = np.asarray([d["embedding"] for d in sorted(answer["data"], key=lambda d: d["index"])], np.float64)
                length = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, length, out=x, where=length > 0)
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list(x), "input_tokens": [int(answer["prompt_tokens"])] + [0] * (len(asked) - 1)})

    return texts.select(key, text).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, embedding array<double>, input_tokens long")


def mock_rerank(query: str, documents: list[str]) -> list[dict]:
    """The shorter text's length over the longer one's in bytes, the best first."""
    size = [(len(query.encode()), len(d.encode())) for d in documents]
    found = [{"index": i, "relevance_score": min(s) / max(*s, 1)} for i, s in enumerate(size)]
    return sorted(found, key=lambda r: -r["relevance_score"])


def rerank(
    candidates: DataFrame, query_key: str, key: str, service: Callable[[str, list[str]], list[dict]] = mock_rerank, query: str = "query", document: str = "document",
    query_form: str = "{query}", document_form: str = "{document}",
) -> DataFrame:
    """query_key, key, score of each candidate, one request a query; scores are put back by their index. No candidates, no rows.

    Candidates of a query are a top list, so a query's group is bounded by its length. The forms' braces are replaced as they stand.
    """
    import pandas as pd
    from pyspark.sql import functions as F

    from ..functions.text import expand

    none = F.lit("")
    rows = candidates.select(
        query_key, key, expand(query_form, F.coalesce(F.col(query), none), none).alias("__query"), expand(document_form, F.coalesce(F.col(query), none), F.coalesce(F.col(document), none)).alias("__document")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        score = [float("nan")] * len(pdf)
        for r in service(pdf["__query"].iloc[0], pdf["__document"].tolist()):
            score[r["index"]] = float(r["relevance_score"])
        if any(s != s for s in score):
            raise ValueError("the answer has no score for some documents")
        return pd.DataFrame({query_key: pdf[query_key].to_numpy(), key: pdf[key].to_numpy(), "score": score})

    types = dict(candidates.dtypes)
    return rows.groupBy(query_key).applyInPandas(run, f"{query_key} {types[query_key]}, {key} {types[key]}, score double")
