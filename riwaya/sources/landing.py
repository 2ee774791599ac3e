"""The landing zone: bodies of addresses, kept by content, with a record of every attempt.

A zone is a folder with ``bodies/`` (one file for each distinct content, named by
its digest) and ``attempts.jsonl``, one line for each attempt to get an address.
What an address holds is the last good line about it; what was not to be had is
read from the same lines, by Spark, as :func:`failures`. No query needs a network.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from pathlib import Path
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds that an answer may take.
PATIENCE = 60


class NothingLanded(LookupError):
    """None of the addresses gave a body, now or before."""

    def __init__(self, addresses: Iterable[str], reasons: Iterable[str]):
        self.addresses, self.reasons = tuple(addresses), tuple(reasons)
        super().__init__("; ".join(f"{a} ({r})" for a, r in zip(self.addresses, self.reasons, strict=True)) or "no address given")


@dataclass(frozen=True)
class Attempt:
    """One line of the record: ``digest`` names the body that came, ``reason`` tells why none did."""

    address: str
    at: float
    digest: str | None = None
    reason: str | None = None


ATTEMPTS = "address string, at double, digest string, reason string"


def over_http(address: str) -> bytes:
    with urlopen(address, timeout=PATIENCE) as answer:
        return answer.read()


class Zone:
    """A landing zone; ``get`` turns an address into its body or raises OSError."""

    def __init__(self, folder: str | Path, get: Callable[[str], bytes] = over_http):
        self.folder, self.get = Path(folder), get
        self.record = self.folder / "attempts.jsonl"

    def attempts(self) -> Iterator[Attempt]:
        if self.record.exists():
            for line in self.record.read_text(encoding="utf-8").splitlines():
                yield Attempt(**json.loads(line))

    def held(self) -> dict[str, Path]:
        """The newest body of each address."""
        return {a.address: self.folder / "bodies" / a.digest for a in self.attempts() if a.digest}

    def _try(self, address: str) -> Attempt:
        try:
            body = self.get(address)
        except OSError as trouble:
            return Attempt(address, time.time(), reason=str(trouble) or type(trouble).__name__)
        digest = hashlib.sha256(body).hexdigest()
        bodies = self.folder / "bodies"
        bodies.mkdir(parents=True, exist_ok=True)
        if not (bodies / digest).exists():
            fresh = bodies / f".{digest}.{time.monotonic_ns()}"
            fresh.write_bytes(body)
            fresh.rename(bodies / digest)
        return Attempt(address, time.time(), digest=digest)

    def fill(self, addresses: Iterable[str], again: bool = False, hands: int = 8) -> list[Attempt]:
        """Get all addresses that aren't held (all, with ``again``), several at a time; each attempt goes on record."""
        have = {} if again else self.held()
        todo = [a for a in dict.fromkeys(addresses) if a not in have]
        with ThreadPoolExecutor(hands) as pool:
            made = list(pool.map(self._try, todo))
        if made:
            self.folder.mkdir(parents=True, exist_ok=True)
            with self.record.open("a", encoding="utf-8") as out:
                out.writelines(json.dumps(asdict(a), ensure_ascii=False) + "\n" for a in made)
        return made

    def body(self, *mirrors: str, again: bool = False) -> Path:
        """The body of the first mirror that has one. With ``again`` each is asked anew before an older body serves."""
        if not again:
            have = self.held()
            for m in mirrors:
                if m in have:
                    return have[m]
        reasons = []
        for m in mirrors:
            (tried,) = self.fill([m], again=True)
            if tried.digest:
                return self.folder / "bodies" / tried.digest
            reasons.append(tried.reason)
        have = self.held()
        for m in mirrors:
            if m in have:
                return have[m]
        raise NothingLanded(mirrors, reasons)


def failures(spark: SparkSession, zone: Zone) -> DataFrame:
    """(seq, message) of addresses of which nothing is held, from the record; what report_unavailable takes."""
    if not zone.record.exists():
        return spark.createDataFrame([], "seq long, message string")
    lines = spark.read.schema(ATTEMPTS).json(str(zone.record))
    lost = lines.groupBy("address").agg(F.max("digest").alias("digest"), F.max_by("reason", "at").alias("reason"), F.min("at").alias("at")).filter("digest is null")
    return lost.select((F.col("at") * 1_000_000).cast("long").alias("seq"), F.concat_ws(": ", "address", "reason").alias("message"))
