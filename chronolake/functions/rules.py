"""Predicates and labels of rows: errors, admission, text cues, limits. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers and patterns that decide the labels.
INPUT_MARKERS = ("音频时长过短", "文件不存在", "不支持的文件格式", "文件太大", "认证失败", "terms 编码无效")
MODEL_PATTERN = r"(?i)VAD algorithm|index .* out of bounds|list index out of range|window size|dimension"
RESOURCE_MARKERS = ("BFCArena", "CUBLAS", "cublas", "cudaMalloc", "CUDA failure", "cudaErrorMemoryAllocation", "out of memory")
BACKCHANNELS = ("对", "嗯嗯", "好的", "是的")
PUNCTUATION_ONLY = r"^[，。！？!?,.\s]+$"
QUESTION_TAIL = r"(对吗|是吧|是不是|有没有|可以吗|好吗|是吗)$"
WIDE_BACKCHANNEL = r"^[，。?!?,.\s]*(对|嗯|啊|是|哦|噢|呃|嗯嗯|对啊|对对|是的|好的)[啊嗯，。!?,.\s]*$"
WIDE_SHORT = r"^[对嗯啊是哦噢呃好的吗，。?!吧呢呀\s]+$"
WILDCARD_HOSTS = ("0.0.0.0", "::")
QUESTION_CUES = ("你觉得", "你们", "可以讲讲", "能不能", "会不会", "有没有", "是不是", "是什么", "为什么", "商业模式", "接下来", "同意.{0,8}吗", "吗[？?]?", "[？?]")
ANSWER_CUES = ("我觉得", "在我看来", "我相信", "我们公司", "我们自己", "我是", "我的", "我刚", "对我来讲", "龙虾", "章鱼", "明略", "开源")


def _has_any(text: Column, parts: tuple) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | text.contains(p)
    return hit


def error_kind(message: Column, queue_full: Column | None = None) -> Column:
    """queue_full, non_retryable_input, model_error or engine_error; a null message counts as empty."""
    m = F.coalesce(message, F.lit(""))
    kind = F.when(queue_full, "queue_full") if queue_full is not None else F
    return kind.when(_has_any(m, INPUT_MARKERS), "non_retryable_input").when(m.rlike(MODEL_PATTERN), "model_error").otherwise("engine_error")


def retryable(kind: Column) -> Column:
    return kind.isin("model_error", "engine_error")


def failure_type(status: Column, message: Column) -> Column:
    """Finer label of a failed row's message; null for other rows and empty messages."""
    label = F.when(message.contains("VAD"), "vad_error").when(_has_any(message, ("索引", "index")), "index_error")
    label = label.when(message.contains("音频"), "audio_error").when(message.contains("模型"), "model_error").otherwise("unknown_error")
    return F.when((status == "failed") & (message != ""), label)


def resource_error(message: Column) -> Column:
    return _has_any(message, RESOURCE_MARKERS)


def backchannel(text: Column, wide: bool = False) -> Column:
    """Empty texts, short assents and bare punctuation. wide: also assents with particles and up to four such characters."""
    t = F.coalesce(text, F.lit(""))
    s = F.trim(t)
    if wide:
        return (s == "") | s.rlike(WIDE_BACKCHANNEL) | ((F.length(s) <= 4) & s.rlike(WIDE_SHORT))
    return (t == "") | s.isin(*BACKCHANNELS) | t.rlike(PUNCTUATION_ONLY)


def question_tail(text: Column, most: int = 14) -> Column:
    s = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(s) <= most) & s.rlike(QUESTION_TAIL)


def cues(text: Column, patterns: tuple) -> Column:
    """How many of the patterns occur."""
    t = F.coalesce(text, F.lit(""))
    total = F.lit(0)
    for p in patterns:
        total = total + t.rlike(p).cast("int")
    return total


def engine_admitted(requested: Column, server: str) -> Column:
    r = F.trim(F.coalesce(requested, F.lit("")))
    return (r == "") | (r == server)


def save_key(key: Column, has_words: Column) -> Column:
    """Key under which a result is kept: without its word part if the words are missing."""
    return F.when(~has_words, F.regexp_replace(key, "\\+wa:[^+]*", "")).otherwise(key)


def cross_engine(key: Column) -> Column:
    """Whether any bare engine's row may answer; keys of variants are strict."""
    return ~key.contains("+")


def health(running: Column, alive: Column) -> Column:
    ok = F.coalesce(running & alive, F.lit(False))
    return F.struct(F.when(ok, 200).otherwise(503).alias("code"), F.when(ok, "healthy").otherwise("degraded").alias("status"))


def metrics_code(path: Column, header: Column, token: Column, host: Column) -> Column:
    """403 where metrics are refused, else null: a set token must come in the query or the header; without one,
    hosts that listen everywhere are refused."""
    asked = F.regexp_extract(path, r"[?&]token=([^&#]+)", 1)
    h = F.trim(header)
    bearer = F.when(F.lower(h).startswith("bearer "), F.trim(F.substring(h, 8, 1_000_000))).otherwise(h)
    given = F.when(asked != "", asked).otherwise(F.nullif(bearer, F.lit("")))
    is_set = F.coalesce(token != "", F.lit(False))
    return F.when(is_set & ~given.eqNullSafe(token), 403).when(~is_set & F.trim(F.coalesce(host, F.lit(""))).isin(*WILDCARD_HOSTS), 403)


def headroom(free: Column, need: Column) -> Column:
    """Unknown memory passes."""
    return F.coalesce(free >= need, F.lit(True))


def extension(name: Column) -> Column:
    """Lower-case extension of a path's last part, with its dot; empty without one."""
    base = F.substring_index(name, "/", -1)
    return F.lower(F.regexp_extract(base, r"[^.](\.[^.]*)$", 1))


def file_admitted(name: Column, size: Column, allowed: tuple, most: int) -> Column:
    return extension(name).isin(*allowed) & (size <= most)


def threads(cpus: Column) -> Column:
    return F.when(cpus <= 4, 2).otherwise(4)


def workers(cpus: Column, docker: Column, mac: Column) -> Column:
    return F.least(F.coalesce(cpus, F.lit(4)), F.when(docker, 4).when(mac, 6).otherwise(8))


def runtime(forced: Column, platform: Column, cuda: Column) -> Column:
    f = F.lower(F.trim(F.coalesce(forced, F.lit(""))))
    return F.when(f.isin("cpu", "mac_ane", "cuda"), f).when(platform == "darwin", "mac_ane").when(platform.startswith("linux") & cuda, "cuda").otherwise("cpu")


def retry_after(seconds: Column, slots: Column) -> Column:
    return F.greatest(F.lit(1), (seconds / F.greatest(slots, F.lit(1))).cast("int"))


def wait_seconds(position: Column, seconds: Column, slots: Column) -> Column:
    ahead = F.greatest(position - 1, F.lit(0))
    return (ahead / F.greatest(slots, F.lit(1)) * seconds).cast("int")
