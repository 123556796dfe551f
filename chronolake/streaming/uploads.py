"""Upload sessions in state: chunks by (upload, index), idle sessions that expire, idempotent finalizing.

A pool is a group of uploads that share a maximum of open sessions, such as those of one server.  Its messages are
taken in order of arrival (at, seq), whatever batches they come in:

    open      upload, total, chunk_bytes, size, md5: a new session, unless the pool has its maximum
    chunk     upload, idx, data, md5 (null: not checked)
    finalize  upload: asks again to hand the upload over
    queue     upload, full: what the queue has answered to an upload that is finalizing
    ping      moves time on

A session that has all chunks is verified and finalizing until the queue answers; if the queue is full it is ready to
be finalized again, without its chunks being sent anew, else it is submitted and its chunks go.  Sessions without a
message for longer than the idle time expire, but not while they are finalizing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronolake.streaming.ordered import ROWS, in_order

MESSAGE = "pool long, at timestamp, seq long, kind string, upload long, idx int, total int, chunk_bytes int, size long, md5 string, data binary, full boolean"
ANSWER = "pool long, upload long, at timestamp, seq long, answer string, progress double, size long, md5 string"
_SESSION = "chunk_bytes int, total int, size long, md5 string, received int, last long, phase string"
UPLOADING, FINALIZING, READY = "uploading", "finalizing", "ready"
#: Fixed value: bytes of a batch's chunks that wait in memory.
FRESH = 64_000_000


def _given(value) -> bool:
    return value is not None and value == value  # pandas has nan where a number is missing


class Sessions(StatefulProcessor):
    def __init__(self, idle_s: int, most: int, remember_s: int):
        self.idle, self.most, self.remember = idle_s * 1_000_000, most, remember_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "upload long", _SESSION)
        self.chunks = handle.getMapState("chunks", "upload long, idx int", "data binary")
        self.submitted = handle.getMapState("submitted", "upload long", "at long")
        self.purge = handle.getValueState("purge", "at long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        out: list[tuple] = []
        for m in in_order(rows, ["at", "seq"]):
            now = m.at.value // 1000  # microseconds
            self._expire(now, out)
            self._take(m, now, out)
            if len(out) >= ROWS:
                yield self._frame(key, out)
                out.clear()
        yield from self._done(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        out: list[tuple] = []
        self._expire(timerValues.getCurrentWatermarkInMs() * 1000, out)
        yield from self._done(key, out)

    def _load(self) -> None:
        """The sessions of the pool, at most as many as it may have open. Chunks stay in the store; those of this batch go there at its
        end, if they are still wanted, or when they are more than FRESH bytes."""
        self.open = {k[0]: list(v) for k, v in self.sessions.iterator()}
        self.kept, self.fresh, self.size = set(self.open), {}, 0  # uploads with chunks in the store, and chunks that aren't there
        self.purge_at = self.purge.get()[0] if self.purge.exists() else None
        self.look = 0  # before this time no session expires
        self.before = {k: tuple(v) for k, v in self.open.items()}

    def _done(self, key, out: list[tuple]) -> Iterator[pd.DataFrame]:
        for upload in self.before.keys() - self.open.keys():
            self.sessions.removeKey((upload,))
        for upload, s in self.open.items():
            if self.before.get(upload) != tuple(s):
                self.sessions.updateValue((upload,), tuple(s))
        self._flush()
        if self.purge_at is not None:
            self.purge.update((self.purge_at,))
        elif self.purge.exists():
            self.purge.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        due = [s[5] + self.idle for s in self.open.values() if s[6] != FINALIZING]
        if self.purge_at is not None:
            due.append(self.purge_at)
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)
        if out:
            yield self._frame(key, out)

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        upload, at, seq, answer, progress, size, md5 = zip(*out)
        frame = pd.DataFrame({"upload": upload, "at": pd.to_datetime(at, unit="us"), "seq": pd.array(seq, "Int64"), "answer": answer, "progress": pd.array(progress, "Float64"), "size": pd.array(size, "Int64"), "md5": list(md5)})
        frame.insert(0, "pool", key[0])
        return frame

    def _has(self, upload: int, idx: int) -> bool:
        return (upload, idx) in self.fresh or upload in self.kept and self.chunks.containsKey((upload, idx))

    def _flush(self) -> None:
        for place, data in self.fresh.items():
            self.chunks.updateValue(place, (data,))
            self.kept.add(place[0])
        self.fresh, self.size = {}, 0

    def _drop(self, upload: int) -> None:
        total = self.open.pop(upload)[1]
        for idx in range(total):
            data = self.fresh.pop((upload, idx), None)
            if data is not None:
                self.size -= len(data)
            elif upload in self.kept and self.chunks.containsKey((upload, idx)):
                self.chunks.removeKey((upload, idx))
        self.kept.discard(upload)

    def _expire(self, now: int, out: list[tuple]) -> None:
        late = [] if now <= self.look else sorted((s[5] + self.idle, u) for u, s in self.open.items() if s[6] != FINALIZING and now - s[5] > self.idle)
        for at, upload in late:
            self._drop(upload)
            out.append((upload, at, None, "expired", None, None, None))
        if now > self.look:
            self.look = min((s[5] + self.idle for s in self.open.values() if s[6] != FINALIZING), default=now)
        self.look = min(self.look, now + self.idle)
        if self.purge_at is not None and now > self.purge_at:
            # submitted uploads are forgotten in one go now and then, so the state stays as large as their rate
            left = {k[0]: v[0] for k, v in self.submitted.iterator()}
            for upload, at in left.items():
                if now - at > self.remember:
                    self.submitted.removeKey((upload,))
            left = [at for at in left.values() if now - at <= self.remember]
            self.purge_at = now + self.remember // 4 if left else None

    def _take(self, m, now: int, out: list[tuple]) -> None:
        def answer(text: str, progress=None, size=None, md5=None) -> None:
            out.append((int(m.upload), now, int(m.seq) if _given(m.seq) else None, text, progress, size, md5))

        if m.kind == "ping" or not _given(m.upload):
            return
        upload = int(m.upload)
        session = self.open.get(upload)
        if m.kind == "open":
            if session is not None:
                answer("session_exists")
            elif len(self.open) >= self.most:
                answer("too_many_sessions")
            elif not (_given(m.total) and _given(m.chunk_bytes) and m.total > 0 and m.chunk_bytes > 0):
                answer("chunked_upload_error")
            else:
                self.open[upload] = [int(m.chunk_bytes), int(m.total), int(m.size) if _given(m.size) else 0, m.md5, 0, now, UPLOADING]
                answer("upload_ready")
        elif m.kind == "finalize" and session is None:
            known = self.submitted.getValue((upload,)) if self.submitted.containsKey((upload,)) else None
            answer("status" if known and now - known[0] <= self.remember else "session_not_found")
        elif session is None:
            answer("session_not_found")
        elif m.kind == "chunk":
            self._chunk(m, upload, session, now, answer)
        elif m.kind == "finalize":
            self._finalize(upload, session, now, answer)
        elif m.kind == "queue" and session[6] == FINALIZING:
            session[5] = now
            if _given(m.full) and m.full:
                session[6] = READY
                answer("queue_full")
            else:
                self.submitted.updateValue((upload,), (now,))
                if self.purge_at is None:
                    self.purge_at = now + self.remember
                answer("upload_complete", 100.0, session[2], session[3])
                self._drop(upload)
        else:
            answer("message_error")

    def _chunk(self, m, upload: int, session: list, now: int, answer) -> None:
        chunk_bytes, total = session[0], session[1]
        if not _given(m.idx):
            return answer("missing_chunk_data")
        idx = int(m.idx)
        if not 0 <= idx < total:
            return answer("upload_error")
        data = bytes(m.data) if m.data is not None else b""
        if not data:
            return answer("missing_chunk_data")
        if len(data) > chunk_bytes or (idx < total - 1 and len(data) < chunk_bytes):
            return answer("upload_error")
        if session[6] != UPLOADING or self._has(upload, idx):
            session[5] = now
            return answer("duplicate", 100.0 * session[4] / total)
        if m.md5 is not None and hashlib.md5(data).hexdigest() != m.md5:
            return answer("chunk_hash_mismatch")
        self.fresh[upload, idx] = data
        self.size += len(data)
        if self.size > FRESH:
            self._flush()
        session[4], session[5] = session[4] + 1, now
        answer("received", 100.0 * session[4] / total)
        if session[4] == total:
            self._finalize(upload, session, now, answer)

    def _finalize(self, upload: int, session: list, now: int, answer) -> None:
        """Verifies what has arrived; once it is right, asking again changes nothing."""
        session[5] = now
        if session[6] == UPLOADING:
            whole, size = hashlib.md5(), 0
            for idx in range(session[1]):
                if self._has(upload, idx):
                    data = self.fresh[upload, idx] if (upload, idx) in self.fresh else self.chunks.getValue((upload, idx))[0]
                    whole.update(data)
                    size += len(data)
            if session[4] < session[1] or whole.hexdigest() != session[3]:
                self._drop(upload)
                return answer("file_hash_mismatch")
            session[2] = size
        session[6] = FINALIZING
        answer("finalizing")


def upload_sessions(messages: DataFrame, idle_s: int = 1800, most: int = 200, remember_s: int = 86_400, late: str = "10 seconds") -> DataFrame:
    """messages: a stream of MESSAGE rows in which at never goes back by more than ``late``. ANSWER rows: one for each
    message but ping, another when the last chunk of an upload has come, and one for each session that expires.

    Messages without an upload are ignored, and those for a session that isn't open get session_not_found. The state
    of a pool is its open sessions with their chunks, and the ids of submitted uploads.
    """
    marked = messages.withWatermark("at", late).filter(F.col("pool").isNotNull() & F.col("at").isNotNull())
    return marked.groupBy("pool").transformWithStateInPandas(Sessions(idle_s, most, remember_s), ANSWER, "Append", "EventTime")
