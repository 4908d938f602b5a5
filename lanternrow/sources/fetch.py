"""Documents from hosts, politely: a host's requests one after another with a gap, robots rules, checksum pins and screens.

What fetches is a function of a request's row, so the same rules run over a network or over stored
responses. Requests are dealt by host and sorted; a task walks its hosts in order and keeps nothing
but the time of a host's last request. A host's pace is a limit by nature: its requests can't run
side by side, however many there are, but they are streamed.
"""

import hashlib
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds between requests to a host.
GAP = 2.0
#: Rows whose bodies are held at once.
ROWS = 32
FETCHED = "status string, reason string, sha256 string, n_bytes long, at double, body binary"


def host_of(url: Column) -> Column:
    """The host of a URL with its port, in lower case."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


class Robots:
    """Rules of a robots.txt for one agent: the group that names it, else that of *; the longest matching rule decides, allow before disallow."""

    def __init__(self, text: str, agent: str):
        groups: dict[str, list[tuple[bool, str]]] = {}
        names: list[str] = []
        fresh = True
        for line in text.splitlines():
            field, _, value = line.partition("#")[0].partition(":")
            field, value = field.strip().lower(), value.strip()
            if field == "user-agent":
                names = [value.lower()] if fresh is False else [*names, value.lower()]
                fresh = True
                for n in names:
                    groups.setdefault(n, [])
            elif field in ("allow", "disallow"):
                fresh = False
                for n in names:
                    if value:
                        groups[n].append((field == "allow", value))
        own = [n for n in groups if n != "*" and n in agent.lower()]
        self.rules = groups[max(own, key=len)] if own else groups.get("*", [])

    def allow(self, url: str) -> bool:
        parts = urlsplit(url)
        path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        best = (-1, True)
        for ok, rule in self.rules:
            pattern = "".join(".*" if c == "*" else re.escape(c) for c in rule.rstrip("$")) + ("$" if rule.endswith("$") else "")
            if re.match(pattern, path):
                best = max(best, (len(rule), ok))
        return best[1]


def fetch(
    requests: DataFrame, get: Callable[[dict], tuple[int, bytes]], robots: Callable[[str], str] = lambda host: "", magic: bytes = b"", gap: float = GAP, agent: str = "lanternrow",
    key: str = "doc_id", given: str | None = None, clock: Callable[[], float] | None = None, sleep: Callable[[float], None] | None = None,
) -> DataFrame:
    """key, status (fetched, failed), reason, sha256, n_bytes, at (seconds after the host's first request), body, of requests (key, url, sha256, manual).

    manual requests are never sent. A host's robots.txt is its first request. A body that doesn't
    begin with magic, or whose checksum isn't the pinned sha256 ('sha256:' and hex; null: not pinned
    yet), fails. given names a column that get sees as row['given'], for stored responses. Without a
    clock times are counted, not waited for.
    """
    columns = [key, "url", "sha256", "manual"] + ([given] if given else [])
    dealt = requests.select(*columns).withColumn("__host", host_of(F.col("url"))).repartition("__host").sortWithinPartitions("__host", "url", key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, rules, sent, began = None, None, 0, 0.0

        def wait() -> float:
            nonlocal sent
            at = sent * gap
            if clock and sleep:
                late = began + at - clock()
                if late > 0:
                    sleep(late)
                at = clock() - began
            sent += 1
            return at

        # a few rows at a time, so bodies don't add up beside their batch
        for pdf in (whole.iloc[at : at + ROWS] for whole in batches for at in range(0, len(whole), ROWS)):
            out = []
            for row in pdf.to_dict("records"):
                if row["__host"] != host:
                    host, rules, sent, began = row["__host"], None, 0, clock() if clock else 0.0
                got = {key: row[key], "status": "failed", "reason": None, "sha256": None, "n_bytes": None, "at": None, "body": None}
                out.append(got)
                if row["manual"]:
                    got["reason"] = "manual document: download it by hand"
                    continue
                if rules is None:
                    wait()
                    rules = Robots(robots(host), agent)
                if not rules.allow(row["url"]):
                    got["reason"] = "robots.txt disallows it"
                    continue
                got["at"] = wait()
                code, body = get(row | {"given": row[given]} if given else row)
                sha = "sha256:" + hashlib.sha256(body).hexdigest()
                pin = row["sha256"] if isinstance(row["sha256"], str) and row["sha256"] else None
                if code != 200:
                    got["reason"] = f"HTTP {code}"
                elif not body.startswith(magic):
                    got["reason"] = "not a document of the kind"
                elif pin and pin != sha:
                    got |= {"reason": "sha256 mismatch", "sha256": sha}
                else:
                    got |= {"status": "fetched", "sha256": sha, "n_bytes": len(body), "body": body}
            yield pd.DataFrame(out, columns=[key, "status", "reason", "sha256", "n_bytes", "at", "body"]).astype({"n_bytes": "Int64", "at": "Float64", "reason": object, "sha256": object, "body": object})

    return dealt.mapInPandas(run, f"{key} {dict(requests.dtypes)[key]}, {FETCHED}")
