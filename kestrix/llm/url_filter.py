"""URL filters over a sorted digest array.

Entries (host and path rules, single blocked words of host names) are stored
as sorted 64-bit xxhash keys with their full strings beside them.  The file of
keys is shipped once to every executor, memory-mapped there, and probed for a
whole Arrow batch at a time by vectorised binary search; a hit counts only if
the stored string equals the probe, so digests that collide cannot decide.
"""

from __future__ import annotations

import atexit
import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production rules: (verdict, rule).  A rule is host and path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Words that block a host when one of its parts between dots and hyphens equals them.
WORDS = ("casino", "casinos", "phish", "phishing", "pills", "porn", "spam", "viagra", "warez", "xxx")
_UPPER = "".join(map(chr, range(65, 91)))
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without ``://``."""
    parts = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(parts(1), _UPPER, _UPPER.lower()), parts(2)


class DigestArray:
    """Sorted 64-bit keys of strings, with a one-byte value and the string itself for each."""

    @staticmethod
    def write(folder: str, entries: dict[str, int]) -> str:
        """Write entries to a file named by its content: 17 bytes each besides the strings, mapped as they are touched."""
        keyed = sorted((xxhash.xxh64_intdigest(k.encode()), k.encode(), v) for k, v in entries.items())
        keys = np.array([x[0] for x in keyed], np.uint64)
        ends = np.cumsum([0, *(len(x[1]) for x in keyed)]).astype(np.uint64)
        values = np.array([x[2] for x in keyed], np.uint8)
        body = b"".join([np.uint64(len(keys)).tobytes(), keys.tobytes(), ends.tobytes(), values.tobytes(), *(x[1] for x in keyed)])
        path = os.path.join(folder, f"digests-{xxhash.xxh64_hexdigest(body)}.bin")
        if not os.path.exists(path):
            with open(path, "wb") as f:
                f.write(body)
        return path

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, mode="r")
        n = int(data[:8].view(np.uint64)[0])
        at = 8
        self.keys, at = data[at : at + 8 * n].view(np.uint64), at + 8 * n
        self.ends, at = data[at : at + 8 * n + 8].view(np.uint64), at + 8 * n + 8
        self.values, at = data[at : at + n], at + n
        self.text = data[at:]

    def find(self, probes: list[bytes]) -> np.ndarray:
        """Value of each probe's entry, or -1."""
        found = np.full(len(probes), -1, np.int16)
        if not len(self.keys) or not probes:
            return found
        digests = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        low = np.searchsorted(self.keys, digests, "left")
        high = np.searchsorted(self.keys, digests, "right")
        for i in np.flatnonzero(high > low):  # equal digests stand together; the strings decide
            for j in range(low[i], high[i]):
                if self.text[int(self.ends[j]) : int(self.ends[j + 1])].tobytes() == probes[i]:
                    found[i] = self.values[j]
        return found


@lru_cache(maxsize=1)
def _folder() -> str:
    """The driver's folder of digest files; it lives as long as the process."""
    folder = tempfile.TemporaryDirectory(prefix="digests-")
    atexit.register(folder.cleanup)
    return folder.name


@lru_cache(maxsize=4)
def _opened(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def judge_urls(pages: DataFrame, rules=RULES, words=WORDS, default: str = "allow") -> DataFrame:
    """Host, path, deciding rule and verdict of every row's url.

    A rule fits its host and the subdomains of it if the url's path starts
    with the rule's path; the longest fitting rule decides.  Without one, a
    host part in words blocks, and default holds otherwise.  A null url, or
    one without ``://``, has an empty host and path and gets default.  Rows
    and their order of columns are (page_id, host, path, rule, verdict);
    repeated rows give repeated results, other columns of pages are ignored,
    an empty table gives an empty result.  Time per url grows with the number
    of distinct lengths among rule hosts and rule paths, not with the number
    of rules.
    """
    spark = pages.sparkSession
    parsed = [(v, r.partition("/")[0], "/" + r.partition("/")[2], r) for v, r in rules]
    verdicts = [v for v, *_ in parsed]
    entries = {f"r\0{h}\0{p}": int(v == "block") for v, h, p, _ in parsed} | {f"w\0{w}": 1 for w in words}
    host_sizes, path_sizes = sorted({len(h) for _, h, _, _ in parsed}), sorted({len(p) for _, _, p, _ in parsed})
    assert set(verdicts) <= {"allow", "block"}
    path = DigestArray.write(_folder(), entries)  # the driver's file server hands it to every executor
    name = os.path.basename(path)
    spark.sparkContext.addFile(path)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digests = _opened(name)
        for batch in batches:
            split = list(zip(batch["host"], batch["path"]))
            probes, owner, shown = [], [], []
            for i, (host, path) in enumerate(split):
                for n in host_sizes:
                    if len(host) == n or len(host) > n and host[-n - 1] == ".":
                        end = host[len(host) - n :]
                        for m in path_sizes:
                            if len(path) >= m:
                                probes.append(f"r\0{end}\0{path[:m]}".encode("utf-8", "surrogatepass"))
                                owner.append(i)
                                shown.append(end + path[:m])
            rule: list[str | None] = [None] * len(split)
            verdict = [default] * len(split)
            for k in np.flatnonzero((values := digests.find(probes)) >= 0):
                if rule[owner[k]] is None or len(shown[k]) > len(rule[owner[k]]):
                    rule[owner[k]], verdict[owner[k]] = shown[k], "block" if values[k] else "allow"
            probes, owner = [], []
            for i, (host, _) in enumerate(split):
                if rule[i] is None and host:
                    parts = set(host.replace("-", ".").split("."))
                    probes += [f"w\0{x}".encode("utf-8", "surrogatepass") for x in parts]
                    owner += [i] * len(parts)
            for k in np.flatnonzero(digests.find(probes) >= 0):
                verdict[owner[k]] = "block"
            yield pd.DataFrame({"page_id": batch["page_id"].array, "host": batch["host"], "path": batch["path"], "rule": pd.Series(rule, dtype=object), "verdict": verdict})

    host, path = split_url(F.col("url").cast("string"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).mapInPandas(judge, SCHEMA)
