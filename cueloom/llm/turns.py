"""Speech transcripts into clean speaker turns.

Labels written in many ways become those of the speaker map. A hidden Markov model whose
states are a job's speakers decides cues that name nobody, or name someone ambiguously:
emissions come from each participant's language profile (hashed character pairs of what
they are known to say), transitions from how often neighbouring cues share a speaker.
Labelled cues pin the chain, so every stretch between two of them is decoded exactly on
its own, and a job of any size is decoded slot by slot.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm.canonical import canonicalize
from cueloom.llm.speech import NOBODY, label_number, name_key, said
from cueloom.operators.ids import with_group_values
from cueloom.operators.runs import SLOT_MS, runs, slot_of
from cueloom.session import written

UNKNOWN = "UNKNOWN"
ALIAS_SLOT_MS = 32 * SLOT_MS
BUCKETS = 64
SMOOTH = 2.0
PRIOR = 4.0
TEMPER = 0.25
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")


@lru_cache(65536)
def who(label: str | None) -> tuple[int | None, str | None]:
    """The speaker number or else the name key of a label; placeholders such as ``?`` or ``unknown`` name nobody."""
    plain = (canonicalize(label) or "").strip() if label else ""
    if plain.casefold() in NOBODY:
        return None, None
    number = label_number(plain)
    return (number, None) if number is not None else (None, name_key(plain) or None)


def evidence(speaker: str | None, text: str | None) -> tuple[int | None, str | None, str | None, str, str | None]:
    """What a cue says of its speaker, and its words: number, name, bare, words, whole.

    The speaker column goes before a label in the text. ``bare`` is the key of a label in the text whose
    form leaves open whether it is one; if it is none, the words are ``whole``.
    """
    what = said(text)
    number, name = who(speaker)
    own, key = who(what.label)
    bare = key if what.whole is not None else None
    if number is None and name is None and bare is None:
        number, name = own, key
    return number, name, bare, what.words, what.whole if bare is not None else None


_PARSED = T.StructType([T.StructField("number", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("name", "bare", "words", "whole"))])


@F.pandas_udf(_PARSED)
def _parse(speaker: pd.Series, text: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([evidence(s, t) for s, t in zip(speaker, text, strict=True)], columns=["number", "name", "bare", "words", "whole"])
    out["number"] = out["number"].astype("Int32")
    return out


parse = _parse.asNondeterministic()  # evaluated once, as filters on its result follow


def alias_keys(display: str | None) -> list[str]:
    """Keys by which a label can mean this person: the whole name, its parts, and for
    names written without spaces every beginning of it."""
    whole = name_key(display)
    if not whole:
        return []
    out = {whole, *(name_key(p) for p in regex.split(r"[\s　・]+", display.strip()))}
    if _CJK.search(whole):
        out |= {whole[:i] for i in range(1, len(whole))}
    return sorted(k for k in out if k)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _alias_keys(display: pd.Series) -> pd.Series:
    return display.map(alias_keys)


def aliases(speaker_map: DataFrame) -> DataFrame:
    """job_id, name, labels: whom a name key can mean in a job. One row a job and key."""
    once = speaker_map.where(F.col("speaker_label").isNotNull()).select("job_id", "speaker_label", "display_name").distinct()
    keys = once.select("job_id", "speaker_label", F.explode(_alias_keys("display_name")).alias("name"))
    return keys.groupBy("job_id", "name").agg(F.sort_array(F.collect_set("speaker_label")).alias("labels"))


def known_labels(rows: DataFrame, key: str, speaker_map: DataFrame, out: str) -> DataFrame:
    """Adds the speaker labels that a job knows under a name key, null where there are none; rows have job_id and start_ms."""
    known = aliases(speaker_map).withColumnRenamed("name", key).withColumnRenamed("labels", out)
    return with_group_values(rows, known, ["job_id", key], slot_of(F.col("start_ms"), ALIAS_SLOT_MS))


def alias_maps(speaker_map: DataFrame) -> DataFrame:
    """job_id and _aliases: all name keys of a job with the labels they can mean, as many as its participants have."""
    return aliases(speaker_map).groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "labels"))).alias("_aliases"))


def spoken(cues: DataFrame, speaker_map: DataFrame) -> DataFrame:
    """PRIMARY cues that say something, with the labels they may belong to; repeated deliveries are repeated.

    Columns: job_id, cue_index, start_ms, words, labels (null: names nobody; one: that
    speaker; several: ambiguous). Cues without a start are left out. A bare label in the text counts
    if the speaker map knows it in this job; else it is part of the words.
    """
    own = cues.where((F.col("source") == "PRIMARY") & F.col("start_sec").isNotNull())
    rows = own.select("job_id", "cue_index", F.round(F.col("start_sec") * 1000).cast("long").alias("start_ms"), parse("speaker", "text").alias("p")).select("job_id", "cue_index", "start_ms", "p.*")
    once = written(rows.where((F.col("words") != "") | (F.col("whole") != "")))
    cols = ["job_id", "cue_index", "start_ms", "words", "labels"]
    numbered = F.when(F.col("number").isNotNull(), F.array(F.format_string("SPEAKER_%02d", F.col("number"))))
    # Numbered labels need no lookup, so only cues that give a name are joined.
    sure = once.where(F.col("name").isNull() & F.col("bare").isNull()).withColumn("labels", numbered)
    asked = with_group_values(once.where(F.col("name").isNotNull() | F.col("bare").isNotNull()), alias_maps(speaker_map), "job_id", slot_of(F.col("start_ms"), ALIAS_SLOT_MS))
    bare = F.try_element_at("_aliases", F.col("bare"))
    named = F.when(F.col("name").isNotNull(), F.try_element_at("_aliases", F.col("name"))).otherwise(F.coalesce(numbered, bare))
    asked = asked.withColumn("labels", named).withColumn("words", F.when(F.col("bare").isNotNull() & bare.isNull(), F.col("whole")).otherwise(F.col("words")))
    return sure.select(*cols).unionByName(asked.where(F.col("words") != "").select(*cols))


def features(*words: str) -> np.ndarray:
    """Counts of hashed neighbouring character pairs over all texts given."""
    codes = np.frombuffer("\0".join(words).casefold().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    left, right = codes[:-1], codes[1:]
    inside = (left != 0) & (right != 0)
    pairs = left[inside] * np.uint64(2654435761) + right[inside] * np.uint64(40503)
    return np.bincount((pairs >> np.uint64(7)).astype(np.int64) % BUCKETS, minlength=BUCKETS)


def _partial_profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums per job and speaker within the partition, flushed when many are held."""
    held: dict[tuple, np.ndarray] = {}

    def frame() -> pd.DataFrame:
        out = pd.DataFrame([(j, s, v.tolist()) for (j, s), v in held.items()], columns=["job_id", "label", "counts"])
        held.clear()
        return out

    for batch in batches:
        texts: dict[tuple, list[str]] = defaultdict(list)
        for job, label, words in zip(batch["job_id"].tolist(), batch["label"].tolist(), batch["words"].tolist(), strict=True):
            texts[job, label].append(words)
        for key, some in texts.items():
            got = features(*some)
            held[key] = held[key] + got if key in held else got
        if len(held) > 20_000:
            yield frame()
    if held:
        yield frame()


def profiles(known: DataFrame) -> DataFrame:
    """job_id, label, counts: the language profile of each participant, over all their cues.

    What is gathered for a participant is a short array for each flush of each task that read some of their cues.
    """
    part = known.mapInPandas(_partial_profiles, "job_id string, label string, counts array<long>")
    none = F.array_repeat(F.lit(0).cast("long"), BUCKETS)
    total = F.aggregate(F.collect_list("counts"), none, lambda sums, more: F.zip_with(sums, more, lambda x, y: x + y))
    return part.groupBy("job_id", "label").agg(total.alias("counts"))


def decode(emit: np.ndarray, allowed: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most probable state of each cue of a sequence, and that probability.

    ``emit``: log emissions, one row a cue; ``allowed``: whether a state is possible there;
    ``step``: log probability of each state (column) after each other (row).
    """
    n, k = emit.shape
    score = np.where(allowed, emit, -1e9)
    forward, backward = np.zeros((n, k)), np.zeros((n, k))
    forward[0] = score[0]
    for t in range(1, n):
        forward[t] = np.logaddexp.reduce(forward[t - 1][:, None] + step, axis=0) + score[t]
    for t in range(n - 2, -1, -1):
        backward[t] = np.logaddexp.reduce(step + (score[t + 1] + backward[t + 1])[None, :], axis=1)
    post = forward + backward
    post = np.exp(post - np.logaddexp.reduce(post, axis=1)[:, None])
    path = post.argmax(axis=1)
    return path, post[np.arange(n), path]


_DECODED = "job_id string, cue_index int, start_ms long, words string, named boolean, label string, probability double"


_OUT = ["job_id", "cue_index", "start_ms", "words", "named", "label", "probability"]
_CUE = ["cue_index", "start_ms", "words", "labels", "own", "at"]


def transitions(states: list[str], after: dict[str, dict[str, int]]) -> np.ndarray:
    """Log probability of each speaker after each other, from how often they followed in this job.

    Counts are smoothed towards the job's own share of turns that stay with a speaker, and that to two in three.
    """
    k = len(states)
    if k == 1:
        return np.zeros((1, 1))
    counts = np.array([[after.get(a, {}).get(b, 0) for b in states] for a in states], dtype=float)
    stay = min(0.95, (np.trace(counts) + 4) / (counts.sum() + 6))
    prior = np.full((k, k), (1 - stay) / (k - 1))
    np.fill_diagonal(prior, stay)
    return np.log((counts + PRIOR * prior) / (counts.sum(axis=1, keepdims=True) + PRIOR))


def decode_slot(job: str | None, cues: list[tuple], profile: list[tuple[str, list[int], dict[str, int] | None]]) -> Iterator[tuple]:
    """Decodes the open cues of a slot, rows of _CUE in order; the others stand beside an open one."""
    labels = [list(c[3]) if c[3] is not None else [] for c in cues]
    states = sorted({*(p[0] for p in profile), *(s for x in labels for s in x)})
    n = len(cues)
    out, sure = [x[0] if len(x) == 1 else None for x in labels], [1.0] * n
    if states:
        at = {s: i for i, s in enumerate(states)}
        counts = np.zeros((len(states), BUCKETS))
        for label, c, _ in profile:
            counts[at[label]] += np.asarray(c, dtype=float)
        # Each participant's profile leans on what all of the job say, the more the less is known of them.
        common = (counts.sum(axis=0) + 1) / (counts.sum() + BUCKETS)
        log_p = np.log((counts + SMOOTH * BUCKETS * common) / (counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS))
        step = transitions(states, {label: dict(after or {}) for label, _, after in profile})
        fixed = [at[x] if x is not None else -1 for x in out]
        place = [c[5] for c in cues]
        i = 0
        while i < n:
            if fixed[i] >= 0:
                i += 1
                continue
            j = i + 1
            while j < n and fixed[j] < 0 and place[j] == place[j - 1] + 1:
                j += 1
            a = i - 1 if i and place[i - 1] == place[i] - 1 else i  # with the labelled neighbours on either side
            b = j + 1 if j < n and place[j] == place[j - 1] + 1 else j
            allowed = np.zeros((b - a, len(states)), dtype=bool)
            emit = np.zeros((b - a, len(states)))
            for t in range(a, b):
                if fixed[t] >= 0:
                    allowed[t - a, fixed[t]] = True
                else:
                    allowed[t - a, [at[s] for s in labels[t]] if labels[t] else slice(None)] = True
                    emit[t - a] = TEMPER * (log_p @ features(cues[t][2]))
            path, post = decode(emit, allowed, step)
            for t in range(i, j):
                out[t], sure[t] = states[path[t - a]], float(post[t - a])
            i = j
    for c, label, p, x in zip(cues, out, sure, labels, strict=True):
        if c[4] and len(x) != 1:
            yield job, c[0], c[1], c[2], bool(x), label, p


def _decode_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by job and slot, profiles before cues, so one slot is held at a time."""
    key: tuple | None = None
    cues: list[tuple] = []
    profile: list[tuple[str, list[int], dict[str, int] | None]] = []
    done: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch[c].tolist() for c in ("job_id", "_slot", "profile_label", "counts", "after", *_CUE)), strict=True):
            if row[:2] != key:
                if cues:
                    done.extend(decode_slot(key[0], cues, profile))
                key, cues, profile = row[:2], [], []
            if row[2] is not None:
                profile.append(row[2:5])
            else:
                cues.append(row[5:])
        if len(done) > 10_000:
            yield pd.DataFrame(done, columns=_OUT)
            done = []
    if cues:
        done.extend(decode_slot(key[0], cues, profile))
    yield pd.DataFrame(done, columns=_OUT)


def _beyond(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """The cues that slots need of those beside them: from the last labelled cue of the slot before, to the first of the next.

    Columns: job_id, _slot (that of the receiving slot), those of _CUE; places go on from the receiver's own.
    """
    back, ahead = rows.where("_tail"), rows.where("_lead")
    before = back.join(summary.select("job_id", "_slot", "n", "next"), ["job_id", "_slot"]).where(F.col("next").isNotNull()).withColumn("at", F.col("at") - F.col("n")).withColumn("_slot", F.col("next"))
    after = ahead.join(summary.select("job_id", "_slot", "last", "last_n"), ["job_id", "_slot"]).where(F.col("last").isNotNull()).withColumn("at", F.col("at") + F.col("last_n")).withColumn("_slot", F.col("last"))
    cols = ["job_id", "_slot", "cue_index", "start_ms", "words", "labels", F.lit(False).alias("own"), F.col("at").cast("int").alias("at")]
    return before.select(*cols).unionByName(after.select(*cols))


def infer(rows: DataFrame, slot_ms: int = SLOT_MS) -> DataFrame:
    """Rows as spoken() gives them, each cue once, with the speaker that the model finds most probable.

    Cues without a job are kept, and have a label only if they name someone by number.
    Columns: job_id, cue_index, start_ms, words, named (whether speaker or text
    name anyone), label (null only where a job knows no speaker) and probability (1 for
    cues that name exactly one). Each stretch of open cues is decoded with its labelled
    neighbours; all other cues never leave the JVM. A stretch that reaches over a slot's edge is
    decoded on either side with all of it that the slot beyond holds up to its next labelled cue, so the slots
    do not show unless a whole slot is without one.
    """
    one = F.coalesce(F.size("labels") == 1, F.lit(False))
    slot = Window.partitionBy("job_id", "_slot")
    order = slot.orderBy("start_ms", "cue_index")
    # Deliveries of one cue have the same content, so they are neighbours in the order that is needed anyway.
    rows = rows.withColumn("_slot", slot_of(F.col("start_ms"), slot_ms)).repartition("job_id", "_slot").withColumn("_again", F.lag("cue_index").over(order)).where(~F.col("_again").eqNullSafe(F.col("cue_index"))).drop("_again")
    rows = rows.withColumn("open", ~one).withColumn("_label", F.when(one, F.col("labels")[0]))
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("_before", F.lag("_label").over(order)).withColumn("_n", F.count(F.lit(1)).over(slot))
    known_at = F.when(one, F.col("at"))
    rows = rows.withColumn("_first", F.min(known_at).over(slot)).withColumn("_last", F.max(known_at).over(slot))
    rows = rows.withColumn("_lead", F.col("at") <= F.coalesce("_first", "_n")).withColumn("_tail", F.col("at") >= F.coalesce("_last", F.lit(1)))
    rows = written(rows.withColumn("_asks", F.max("open").over(slot)).withColumn("_beside", F.coalesce(F.lag("open").over(order), F.lit(False)) | F.coalesce(F.lead("open").over(order), F.lit(False)) | (F.col("at") == 1) | (F.col("at") == F.col("_n"))))
    by_slot = Window.partitionBy("job_id").orderBy("_slot")
    summary = rows.groupBy("job_id", "_slot").agg(F.count(F.lit(1)).alias("n"), F.min_by("_label", "at").alias("_head"), F.max_by("_label", "at").alias("_end"))
    summary = summary.withColumn("last", F.lag("_slot").over(by_slot)).withColumn("last_n", F.lag("n").over(by_slot)).withColumn("next", F.lead("_slot").over(by_slot)).withColumn("_from", F.lag("_end").over(by_slot))
    pairs = rows.select("job_id", F.col("_before").alias("a"), F.col("_label").alias("b")).unionByName(summary.select("job_id", F.col("_from").alias("a"), F.col("_head").alias("b")))
    follows = pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy("job_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    after = follows.groupBy("job_id", F.col("a").alias("label")).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("after"))  # as many as a job has speakers
    known = rows.where(~F.col("open")).select("job_id", F.col("_label").alias("label"), "words")
    model = profiles(known).join(after, ["job_id", "label"], "left").select("job_id", F.col("label").alias("profile_label"), "counts", "after")
    # Python sees the open cues and their neighbours, with their job's model beside them.
    open_slots = rows.where("open").select("job_id", "_slot").distinct()
    near = open_slots.withColumn("_near", F.floor(F.col("_slot") / 64))
    models = near.select("job_id", "_near").distinct().join(model, "job_id")
    blank = {"cue_index": F.lit(0), "start_ms": F.lit(0).cast("long"), "words": F.lit(None).cast("string"), "labels": F.lit(None).cast("array<string>"), "own": F.lit(False), "at": F.lit(-(1 << 30))}
    per_slot = near.join(models, ["job_id", "_near"]).select("job_id", "_slot", "profile_label", "counts", "after", *(blank[c].alias(c) for c in _CUE))
    inside = rows.where(F.col("open") | F.col("_beside") & F.col("_asks")).select("job_id", "_slot", "cue_index", "start_ms", "words", "labels", F.lit(True).alias("own"), F.col("at").cast("int").alias("at"))
    asked = inside.unionByName(_beyond(rows, summary).join(open_slots, ["job_id", "_slot"], "left_semi"))
    asked = asked.select("job_id", "_slot", F.lit(None).cast("string").alias("profile_label"), F.lit(None).cast("array<long>").alias("counts"), F.lit(None).cast("map<string,bigint>").alias("after"), *_CUE)
    both = per_slot.unionByName(asked).repartition("job_id", "_slot").sortWithinPartitions("job_id", "_slot", "at")
    decoded = both.mapInPandas(_decode_all, _DECODED)
    plain = rows.where(~F.col("open")).select("job_id", "cue_index", "start_ms", "words", F.lit(True).alias("named"), F.col("_label").alias("label"), F.lit(1.0).alias("probability"))
    return plain.unionByName(decoded)


def labelled(cues: DataFrame, speaker_map: DataFrame, slot_ms: int = SLOT_MS) -> DataFrame:
    """PRIMARY cues that say something, with the speaker the model gives each: spoken() and infer()."""
    return infer(spoken(cues, speaker_map), slot_ms)


def turns(cues: DataFrame, speaker_map: DataFrame, infer: bool = False, slot_ms: int = SLOT_MS) -> DataFrame:
    """Longest runs of PRIMARY cues of a job, by start, with the same speaker.

    Columns: job_id, speaker_label, first_cue_index, last_cue_index, first_start_ms,
    last_start_ms, n_cues. Cues that name nobody are UNKNOWN and form turns of their own,
    or with infer=True go to the speaker the model finds most probable. Cues that say
    nothing (null or blank texts, only fillers, annotations and clock readings) belong to
    no turn and end none. Repeated deliveries count once; equal starts go by cue_index.
    """
    found = labelled(cues, speaker_map, slot_ms)
    keep = F.col("label") if infer else F.when(F.col("named"), F.col("label"))
    rows = found.select("job_id", "start_ms", "cue_index", F.coalesce(keep, F.lit(UNKNOWN)).alias("label"))
    out = runs(rows, ["job_id"], "start_ms", ["cue_index", "label"], lambda before, now: before("label") != now("label"), slot_ms)
    return out.select(
        "job_id", F.col("first.label").alias("speaker_label"), F.col("first.cue_index").alias("first_cue_index"), F.col("last.cue_index").alias("last_cue_index"),
        F.col("first.start_ms").alias("first_start_ms"), F.col("last.start_ms").alias("last_start_ms"), F.col("n").alias("n_cues"),
    )
