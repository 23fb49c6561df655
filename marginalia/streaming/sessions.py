"""Rotation of refresh tokens: a token is good for one refresh, and one that comes back afterwards ends all sessions of its user.

Over a table the events of a user are taken in order of time; over a stream as they arrive. Both go through the same steps.

sessions: token, user_id, expires (microseconds), active (whether the user still is). events: user_id is the token's, found by a join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

#: The codes of refusals.
INVALID, REUSED = "INVALID_REFRESH_TOKEN", "REFRESH_TOKEN_REUSED"
TOKEN_LIFE_US = 30 * 24 * 3_600_000_000
#: Hits and seconds of each limiter.
LIMITS = {"register": ((5, 3600),), "login": ((10, 900),), "verify": ((10, 900),), "resend": ((1, 60), (5, 3600))}

#: kind: issue (a login: token begins to exist), refresh (token for new_token), logout, deactivate (the user).
EVENT = "user_id long, at long, seq long, kind string, token string, new_token string"
OUTCOME = "user_id long, at long, seq long, kind string, token string, result string, revoked long"


class Sessions:
    """The tokens of one user: when each expires, and which are revoked."""

    def __init__(self, live: dict[str, int] | None = None, revoked: dict[str, int] | None = None, active: bool = True):
        self.live, self.revoked, self.active = live or {}, revoked or {}, active

    def forget(self, now: int) -> None:
        """Tokens that expired so long ago that they are only unknown by now."""
        for own in (self.live, self.revoked):
            for token in [t for t, expires in own.items() if expires < now]:
                del own[token]

    def _revoke(self, token: str) -> int:
        if token in self.live:
            self.revoked[token] = self.live.pop(token)
            return 1
        return 0

    def step(self, kind: str, at: int, token: str | None, new_token: str | None, life: int) -> tuple[str | None, int]:
        """OK or a code, and how many tokens were revoked by it."""
        if kind == "issue":
            if self.active and token is not None:
                self.live[token] = at + life
            return ("OK" if self.active else "ACCOUNT_DEACTIVATED"), 0
        if kind == "deactivate":
            self.active = False
            return "OK", 0
        if kind == "logout":
            return "OK", self._revoke(token)
        if token in self.revoked:
            gone = list(self.live)
            return REUSED, sum(self._revoke(t) for t in gone)
        if token not in self.live or self.live[token] < at:
            return INVALID, 0
        if not self.active:
            return INVALID, self._revoke(token)
        self._revoke(token)
        if new_token is not None:
            self.live[new_token] = at + life
        return "OK", 1


def rotated(events: DataFrame, life_us: int = TOKEN_LIFE_US) -> DataFrame:
    """Per event (``EVENT``): result (OK or a code) and revoked, how many tokens it ended.

    A refresh ends its token and begins the new one; a token that was ended before, by a refresh, a logout or a reuse, ends all live tokens of the user when it is
    presented again. Unknown and expired tokens are refused, and so are those of a user who isn't active, whose token ends. Events of a user go by (at, seq);
    those without a user are refused as unknown.

    At scale: what one event does depends on those before it, so a user's events pass through one task as a sorted stream, which keeps that user's tokens: as a
    revoked one ends all sessions whenever it comes back, none of them can be forgotten.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, own = object(), Sessions()
        for batch in batches:
            rows, results, ended = batch.to_pylist(), [], []
            for r in rows:
                if r["user_id"] != user:
                    user, own = r["user_id"], Sessions()
                result, n = own.step(r["kind"], r["at"], r["token"], r["new_token"], life_us)
                results.append(result)
                ended.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(results, pa.string()), pa.array(ended, pa.int64())], names=[*batch.schema.names[:5], "result", "revoked"])

    columns = [x.split()[0] for x in EVENT.split(", ")]
    known = events.filter("user_id IS NOT NULL").select(*columns)
    done = known.repartition("user_id").sortWithinPartitions("user_id", "at", "seq").mapInArrow(run, OUTCOME)
    unknown = events.filter("user_id IS NULL").select(*columns[:5], F.when(F.col("kind") == "refresh", INVALID).otherwise("OK").alias("result"), F.lit(0).cast("long").alias("revoked"))
    return done.unionByName(unknown)


class _Rotation(StatefulProcessor):
    """One user's tokens as state: a map from token to (expires, revoked), a flag, and a timer at the last expiry, when all of it goes."""

    def __init__(self, life_us: int):
        self.life_us = life_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tokens = handle.getMapState("tokens", StructType([StructField("token", StringType())]), StructType([StructField("expires", LongType()), StructField("revoked", BooleanType())]))
        self.flag = handle.getValueState("active", StructType([StructField("active", BooleanType())]))

    def _load(self) -> Sessions:
        own = Sessions(active=not self.flag.exists() or self.flag.get()[0])
        for key, value in self.tokens.iterator():
            (own.revoked if value[1] else own.live)[key[0]] = value[0]
        return own

    def _store(self, own: Sessions) -> None:
        self.tokens.clear()
        for revoked, part in ((False, own.live), (True, own.revoked)):
            for token, expires in part.items():
                self.tokens.updateValue((token,), (expires, revoked))
        if not own.active:
            self.flag.update((False,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        own = self._load()
        given = pd.concat(list(rows)).sort_values(["at", "seq"])
        done = [own.step(r.kind, int(r.at), r.token, r.new_token, self.life_us) for r in given.itertuples(index=False)]
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        own.forget(now)
        self._store(own)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = max([*own.live.values(), *own.revoked.values()], default=None)
        if last is not None:
            self.handle.registerTimer(last // 1000 + 1)
        out = given[["user_id", "at", "seq", "kind", "token"]].copy()
        out["result"], out["revoked"] = [d[0] for d in done], [d[1] for d in done]
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        own = self._load()
        own.forget(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._store(own)
        yield pd.DataFrame(columns=["user_id", "at", "seq", "kind", "token", "result", "revoked"])

    def close(self) -> None:
        pass


def rotated_stream(events: DataFrame, life_us: int = TOKEN_LIFE_US) -> DataFrame:
    """``rotated`` over a stream of events that have a user: those of one trigger go by (at, seq), those of later triggers are later. State is a user's tokens that haven't
    expired; a timer at the last expiry clears it. It needs the RocksDB state store."""
    columns = [x.split()[0] for x in EVENT.split(", ")]
    return events.select(*columns).groupBy("user_id").transformWithStateInPandas(_Rotation(life_us), OUTCOME, "Append", "ProcessingTime")


def limiter_rules() -> Iterable[tuple[str, int, int]]:
    """route, most, window in microseconds."""
    return [(route, most, seconds * 1_000_000) for route, rules in LIMITS.items() for most, seconds in rules]
