"""Annotation sessions as folds of event logs, in batch and in streams.

An action is a small function that tells which fields of the session change, or
nothing where it does not apply; one place applies the change and keeps the undo
stack, of at most 32 states. States share what did not change. Spark deals events
by session in order and a task holds one session's state at a time, however long
its log is. What a session shows (cuts, marks, cursors) are DataFrame operators on
the folded states.

Defined results: null or unknown actions and ones that do not apply change nothing
but the count of events; equal sequence numbers fold in the order of their action and
arguments; an empty log gives no session.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxelake.functions import geometry as g
from voxelake.functions.rules import prompt_opacity
from voxelake.functions.views import PLANES, same_cut

DEPTH = 32
COLOURS = 8
OUT = "session_id long, n_events long, n_objects long, n_cuts long, n_prompts long, n_grown long, active long, counter long, undo_depth long, state string"
CUT = "struct<key:string,plane:string,series:string,depth:double,origin:string,points:array<struct<at:array<double>,positive:boolean>>,box:array<array<double>>,part:string>"
STATE = f"objects array<struct<id:long,label:string,colour:int,hidden:boolean,growth:string,cuts:array<{CUT}>>>, active long, pending array<string>, counter long"

Change = dict | None


def empty() -> dict:
    return {"objects": [], "active": None, "pending": None, "counter": 0, "past": [], "events": 0}


def slice_key(series: str, plane: str, depth: float) -> str:
    """A cut's name: its depth to three decimals, halves away from zero."""
    return f"{series}|{plane}|{Decimal(depth).quantize(Decimal('0.001'), ROUND_HALF_UP)}"


def _objects(s: dict, of: int | None, change: Callable[[dict], dict | None]) -> list | None:
    """The objects with one of them changed; nothing if there is none or ``change`` refuses."""
    own = next((o for o in s["objects"] if o["id"] == of), None)
    new = own and change(own)
    return new and [new if o is own else o for o in s["objects"]]


def _edited(objects: list | None, **more) -> Change:
    return None if objects is None else {"objects": objects, **more}


def _put(cuts: list, cut: dict) -> list:
    """``cuts`` with ``cut`` in the place of the one that has its key, or at the end."""
    at = [c["key"] == cut["key"] for c in cuts]
    return [cut if same else c for same, c in zip(at, cuts, strict=True)] if any(at) else [*cuts, cut]


def _cut(a: dict, origin: str) -> dict:
    return {"key": slice_key(a["series"], a["plane"], a["depth"]), "plane": a["plane"], "series": a["series"], "depth": a["depth"], "origin": origin, "points": [], "box": None, "part": None}


def _add(s: dict, a: dict) -> Change:
    uses = [sum(o["colour"] == c for o in s["objects"]) for c in range(COLOURS)]
    new = s["counter"] + 1  # never used again, not even after undo
    label = a.get("label") or f"Object {len(s['objects']) + 1}"
    return {"objects": [*s["objects"], {"id": new, "label": label, "colour": uses.index(min(uses)), "hidden": False, "growth": None, "cuts": []}], "active": new, "pending": None, "counter": new}


def _select(s: dict, a: dict) -> Change:
    return {"active": a["object"], "pending": None} if any(o["id"] == a["object"] for o in s["objects"]) else None


def _rename(s: dict, a: dict) -> Change:
    label = a["label"].strip()
    return _edited(_objects(s, a["object"], lambda o: {**o, "label": label})) if label else None


def _hide(s: dict, a: dict) -> Change:
    return _edited(_objects(s, a["object"], lambda o: {**o, "hidden": bool(a["hidden"])}))


def _remove(s: dict, a: dict) -> Change:
    left = [o for o in s["objects"] if o["id"] != a["object"]]
    if len(left) == len(s["objects"]):
        return None
    last = left[-1]["id"] if left else None
    return {"objects": left, "active": last if s["active"] == a["object"] else s["active"], "pending": None}


def _prompt(s: dict, a: dict) -> Change:
    """A click or a box on the active object, which is made if there is none; the cut's mask goes."""
    begun = _add(s, {}) if s["active"] is None else {}
    s = {**s, **begun}
    own = next(o for o in s["objects"] if o["id"] == s["active"])
    near = (c for c in own["cuts"] if (c["plane"], c["series"]) == (a["plane"], a["series"]) and abs(c["depth"] - a["depth"]) <= a["thickness"] / 2 + 1e-9)
    cut = {**next(near, _cut(a, "user")), "origin": "user", "part": None}  # a grown slice is the user's from now on
    if "start" in a:
        cut["box"] = [a["start"], a["end"]]
    else:
        cut["points"] = [*cut["points"], {"at": a["at"], "positive": bool(a["positive"])}]
    return {**begun, "objects": _objects(s, s["active"], lambda o: {**o, "cuts": _put(o["cuts"], cut)}), "pending": [str(s["active"]), cut["key"]]}


def _on_cut(s: dict, a: dict, change: Callable[[dict], list[dict]]) -> list | None:
    """The objects with one cut replaced by what ``change`` gives; nothing if there is no such cut."""

    def own(o: dict) -> dict | None:
        if any(c["key"] == a["key"] for c in o["cuts"]):
            return {**o, "cuts": [x for c in o["cuts"] for x in (change(c) if c["key"] == a["key"] else [c])]}
        return None

    return _objects(s, a["object"], own)


def _clear_cut(s: dict, a: dict) -> Change:
    return _edited(_on_cut(s, a, lambda c: []), pending=None)


def _attach(s: dict, a: dict) -> Change:
    answered = s["pending"] == [str(a["object"]), a["key"]]
    return _edited(_on_cut(s, a, lambda c: [{**c, "part": a["part"]}]), pending=None if answered else s["pending"])


def _grow(s: dict, a: dict) -> Change:
    return _edited(_objects(s, a["object"], lambda o: {**o, "cuts": _put(o["cuts"], {**_cut(a, "grown"), "part": a["part"]})}))


def _clear_grown(s: dict, a: dict) -> Change:
    return _edited(_objects(s, a["object"], lambda o: {**o, "growth": None, "cuts": [c for c in o["cuts"] if c["origin"] == "user"]}))


def _note_growth(s: dict, a: dict) -> Change:
    return _edited(_objects(s, a["object"], lambda o: {**o, "growth": a["growth"]}))


def _undo(s: dict, a: dict) -> Change:
    return {"objects": s["past"][-1][0], "active": s["past"][-1][1], "pending": None, "past": s["past"][:-1]} if s["past"] else None


#: What users do, which undo takes back, and what happens besides.
BY_USER = {"add": _add, "select": _select, "rename": _rename, "hide": _hide, "remove": _remove, "point": _prompt, "box": _prompt, "clear_cut": _clear_cut, "clear_grown": _clear_grown, "note_growth": _note_growth}
BESIDES = {"attach": _attach, "grow": _grow, "undo": _undo}


def apply(s: dict, action: str | None, args: dict) -> dict:
    """The session after one event."""
    does = BY_USER.get(action) or BESIDES.get(action)
    change = (does and does(s, args)) or {}
    if change and action in BY_USER:
        change["past"] = [*s["past"], [s["objects"], s["active"]]][-DEPTH:]
    return {**s, **change, "events": s["events"] + 1}


def packed(s: dict) -> str:
    """The session as JSON, each object, cut and point once, however many states of the undo stack share it."""
    pool, at = [], {}

    def put(x):
        if not isinstance(x, dict | list):
            return x
        if id(x) not in at:
            body = {k: put(v) for k, v in x.items()} if isinstance(x, dict) else [put(v) for v in x]
            at[id(x)] = len(pool)
            pool.append(body)
        return [at[id(x)]]  # a list in a body is the place of another one

    put(s)
    return json.dumps(pool, separators=(",", ":"))


def unpacked(text: str) -> dict:
    """The session that ``packed`` wrote; its states share again what they shared."""
    made = []
    of = lambda v: made[v[0]] if isinstance(v, list) else v
    for body in json.loads(text):
        made.append({k: of(v) for k, v in body.items()} if isinstance(body, dict) else [of(v) for v in body])
    return made[-1]


def summary(session_id: int, s: dict) -> tuple:
    cuts = [c for o in s["objects"] for c in o["cuts"]]
    shown = json.dumps({k: s[k] for k in ("objects", "active", "pending", "counter")})
    prompts, grown = sum(len(c["points"]) + (c["box"] is not None) for c in cuts), sum(c["origin"] == "grown" for c in cuts)
    return session_id, s["events"], len(s["objects"]), len(cuts), prompts, grown, s["active"], s["counter"], len(s["past"]), shown


SCHEMA = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in OUT.split(", ")])


def fold(events: DataFrame) -> DataFrame:
    """One row a session of events (session_id, seq, action, args as JSON): its counts and its state as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s, done = None, empty(), []
        for b in batches:
            for of, action, args in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != now:
                    if now is not None:
                        done.append(summary(now, s))
                    now, s = of, empty()
                s = apply(s, action, json.loads(args or "{}"))
            yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in done], SCHEMA)
            done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, summary(now, s), strict=True))], SCHEMA)

    rows = events.filter("session_id is not null").select(F.col("session_id").cast("long").alias("session_id"), "seq", "action", "args")
    dealt = rows.repartition("session_id").sortWithinPartitions("session_id", "seq", "action", "args")
    return dealt.select("session_id", "action", "args").mapInArrow(run, OUT)


def fold_stream(events: DataFrame) -> DataFrame:
    """The running summary of each session of a stream, updated every micro-batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = unpacked(state.get[0]) if state.exists else empty()
        rows = pd.concat([b[["seq", "action", "args"]] for b in batches])
        for action, args in rows.sort_values(["seq", "action", "args"])[["action", "args"]].itertuples(index=False):
            s = apply(s, action, json.loads(args or "{}"))
        state.update((packed(s),))
        frame = pd.DataFrame([summary(int(key[0]), s)], columns=SCHEMA.names)
        yield frame.astype({c: "Int64" for c in SCHEMA.names if c != "state"})

    return events.groupBy("session_id").applyInPandasWithState(run, OUT, T.StructType([T.StructField("json", T.StringType())]), "update", GroupStateTimeout.NoTimeout)


# --- what sessions show ---


def cuts(states: DataFrame) -> DataFrame:
    """A row for each cut of each object: session_id, nth, object, label, colour, hidden, active and the cut's own columns."""
    s = states.select("session_id", F.from_json("state", STATE).alias("s"))
    o = s.select("session_id", "s.active", F.posexplode("s.objects").alias("o_nth", "o"))
    c = o.select("session_id", "active", "o_nth", "o", F.posexplode("o.cuts").alias("c_nth", "c"))
    return c.select("session_id", F.struct("o_nth", "c_nth").alias("nth"), F.col("o.id").alias("object"), "o.label", "o.colour", "o.hidden", F.coalesce(F.col("active") == F.col("o.id"), F.lit(False)).alias("active"), "c.*")


def prompt_marks(cuts: DataFrame, plane: Column, depth: Column, thickness: float) -> DataFrame:
    """The clicks to draw on a cut: a row each, fading with the distance off it."""
    shown = cuts.filter(~F.col("hidden") & (F.col("plane") == plane)).withColumn("opacity", prompt_opacity(F.col("depth") - depth, thickness)).filter("opacity > 0")
    return shown.select("session_id", "object", "colour", "active", "opacity", F.explode("points").alias("p")).select("session_id", "object", "colour", "active", "p.at", "p.positive", "opacity")


def box_marks(cuts: DataFrame, plane: Column, depth: Column, thickness: float) -> DataFrame:
    """The boxes to draw on a cut, fading likewise."""
    shown = cuts.filter(~F.col("hidden") & (F.col("plane") == plane) & F.col("box").isNotNull()).withColumn("opacity", prompt_opacity(F.col("depth") - depth, thickness))
    return shown.filter("opacity > 0").select("session_id", "object", "colour", "active", "box", "opacity")


def visible_parts(cuts: DataFrame, plane: Column, depth: Column, thickness: float) -> DataFrame:
    """The masks to draw on a cut; ``nth`` is the order to draw them in."""
    shown = cuts.filter(~F.col("hidden") & (F.col("plane") == plane) & F.col("part").isNotNull())
    return shown.filter(same_cut(F.col("depth"), depth, thickness)).select("session_id", "nth", "object", "colour", "active", "origin", "part")


def cut_cursor(cut_plane: Column, cut_depth: Column, cursor: g.Vec) -> g.Vec:
    """The cursor moved along the plane's normal onto the cut."""
    normal = tuple(F.coalesce(*(F.when(cut_plane == n, float(w[i])) for n, (_, _, w) in PLANES.items())) for i in range(3))
    off = cut_depth - g.dot(cursor, normal)
    return g.add(cursor, g.scale(normal, off))


# --- the driver's events as session events ---

ACTIONS = {"click": "point", "purchase": "box", "signup": "add", "view": "select", "error": "undo"}


def from_events(events: DataFrame) -> DataFrame:
    """Prompts fall on twelve cuts by the event's id and value, selections on one of eight objects; unknown types do nothing."""
    action = F.coalesce(F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))[F.col("event_type")], F.lit("none"))
    nth = F.pmod(F.floor(F.abs("value")), F.lit(1 << 20))
    at = F.array(F.col("value"), F.lit(0.0), F.lit(0.0))
    place = dict(plane=F.get(F.array(*map(F.lit, PLANES)), F.col("event_id") % 3), series=F.lit("s"), depth=(nth % 4).cast("double"), thickness=F.lit(1.0))
    named = lambda **c: F.to_json(F.struct(*(x.alias(n) for n, x in c.items())))
    args = F.when(action == "point", named(**place, at=at, positive=F.col("value") > 0)).when(action == "box", named(**place, start=at, end=at)).when(action == "select", named(object=nth % 8 + 1)).otherwise("{}")
    return events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), action.alias("action"), args.alias("args"))
