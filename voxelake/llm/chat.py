"""Chat formatting by quotation linking, in DataFrame and SQL functions only.

A message's lines have a quote level (the ">" marks before them). Lines of level 0
are its own text; runs of lines of one higher level are quoted passages. A
passage, and its paragraphs and lines, are normalised (white space, case) and
hashed, and so are the own texts of all messages; the join on conversation and
hash links a quoting message to the first message of the conversation that said
it. The nearest link (lowest quote level, largest part, latest message) makes a
message a reply. Messages come out without quotes, in reply order: by thread
root, depth and turn.

Original passages are reduced to their first turn before the join, so its one side
has a row a key; the join deals by conversation and passage, so one huge
conversation spreads over all tasks; depths come from pointer jumping, whose
rounds are the logarithm of the longest reply chain.

Defined results: null text is a message without text or quotes (clean text null);
an empty text stays empty; a null conversation or turn takes part in no link;
messages of equal turn share one place in the thread; repeated rows are all
returned; a quote of nothing known, or only of later messages, links nothing;
single lines and paragraphs under ``least_chars`` characters are too common to link,
but whole quotes of any length link to whole messages; texts of any
length are read whole; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelake.llm.common import materialize

MARKS = r"^[ \t]*((?:>[ \t]?)+)"
QUOTES = r"(?:^|\n)[ \t]*>"
WROTE = r"(?i)(wrote|writes|schrieb|écrit|escribió)[ \t]*:[ \t]*$"
EDGES = r"^\s+|\s+$"


def normal(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "^ | $", ""))


def parse(messages: DataFrame) -> DataFrame:
    """Adds own (clean text), said and quoted (passages: level, grain, text); texts without quotes are not taken apart."""
    quotes = F.coalesce(F.col("text").rlike(QUOTES), F.lit(False))
    rows = messages.withColumn("ls", F.when(quotes, F.split("text", r"\r?\n")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("lv", F.transform("ls", lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", ""))))
    rows = rows.withColumn("bs", F.transform("ls", lambda x: F.regexp_replace(x, MARKS, "")))
    # a line such as "Ann wrote:" before a quote belongs to the quote
    credit = lambda i: F.get("bs", i).rlike(WROTE) & (F.coalesce(F.get("lv", i + 1), F.lit(0)) > F.get("lv", i))
    places = F.when(F.size("ls") > 0, F.sequence(F.lit(0), F.size("ls") - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(F.filter(places, lambda i: (F.get("lv", i) == 0) & ~credit(i)), lambda i: F.get("bs", i))
    rows = rows.withColumn("own", F.when(F.size("ls") == 0, F.col("text")).otherwise(F.regexp_replace(F.regexp_replace(F.array_join(own, "\n"), EDGES, ""), r"\n{3,}", "\n\n")))
    starts = F.filter(places, lambda i: (i == 0) | (F.get("lv", i) != F.get("lv", i - 1)))
    rows = rows.withColumn("starts", starts)
    runs = F.transform("starts", lambda s, k: F.struct(F.get("lv", s).alias("level"), F.array_join(F.slice("bs", s + 1, F.coalesce(F.get("starts", k + 1), F.size("ls")) - s), "\n").alias("body")))
    rows = rows.withColumn("runs", F.filter(runs, lambda r: r["level"] > 0))
    return rows.withColumn("quoted", F.flatten(F.transform("runs", lambda r: passages(r["body"], r["level"])))).withColumn("said", passages(F.coalesce("own", F.lit("")), F.lit(0)))


def passages(body: Column, level: Column) -> Column:
    """The whole, its paragraphs and its lines, normalised, as (level, grain, passage)."""
    as_grain = lambda parts, g: F.transform(parts, lambda x: F.struct(level.alias("level"), F.lit(g).alias("grain"), normal(x).alias("passage")))
    return F.concat(as_grain(F.array(body), 0), as_grain(F.split(body, r"\r?\n[ \t]*\r?\n"), 1), as_grain(F.split(body, r"\r?\n"), 2))


def _jump(links: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn, depth of every linked turn, by doubling the jumps."""
    state = materialize(links.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth")), "jumps")
    while True:
        on = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        joined = state.join(on, ["conv_id", "up"], "left")
        state = materialize(joined.select("conv_id", "turn", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")), "jumps")
        if not state.filter("moved").limit(1).count():
            return state.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth")
        state = state.drop("moved")


def format_chat(messages: DataFrame, *, least_chars: int = 12) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, parent_turn, root_turn, depth, formatted; in reply order."""
    rows = parse(messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text"))
    placed = rows.filter("conv_id is not null and turn is not null")

    def exploded(some: DataFrame, column: str) -> DataFrame:
        each = some.select("conv_id", "turn", F.explode(column).alias("p")).select("conv_id", "turn", "p.level", "p.grain", "p.passage")
        return each.filter(F.length("passage") >= F.when(F.col("grain") == 0, 1).otherwise(least_chars)).withColumn("h", F.sha2("passage", 256)).drop("passage")

    quoted = materialize(exploded(placed, "quoted"), "quoted")
    wanted = quoted.select("conv_id", "h").distinct()
    # only conversations with quotes are asked what they said
    said = exploded(placed.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi"), "said").select("conv_id", "turn", "h")
    first = said.join(wanted, ["conv_id", "h"], "left_semi").groupBy("conv_id", "h").agg(F.min("turn").alias("parent_turn"))
    near = F.min(F.struct("level", "grain", (-F.col("parent_turn")).alias("back")))
    links = materialize(quoted.join(first, ["conv_id", "h"]).filter("parent_turn < turn").groupBy("conv_id", "turn").agg(near.alias("b")).select("conv_id", "turn", (-F.col("b.back")).alias("parent_turn")), "links")
    threads = links.join(_jump(links), ["conv_id", "turn"])
    out = rows.select("conv_id", "turn", "role", F.col("own").alias("text"), F.size("runs").cast("long").alias("n_quotes")).join(threads, ["conv_id", "turn"], "left")
    out = out.withColumn("root_turn", F.coalesce("root_turn", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")))
    return out.select("conv_id", "turn", "role", "text", "n_quotes", "parent_turn", "root_turn", "depth", formatted.alias("formatted")).orderBy("conv_id", "root_turn", "depth", "turn")


ORACLE = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM conversations),
l AS (SELECT *, list_transform(ls, lambda x: length(regexp_replace(regexp_extract(x, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g'))) AS lv, list_transform(ls, lambda x: regexp_replace(x, '^[ \t]*((?:>[ \t]?)+)', '')) AS bs FROM m),
x AS (SELECT id, unnest(lv) AS lv, unnest(bs) AS b, unnest(range(1, len(ls) + 1)) AS i FROM l),
y AS (SELECT *, lead(lv) OVER w AS nxt, CASE WHEN lag(lv) OVER w IS DISTINCT FROM lv THEN 1 ELSE 0 END AS s FROM x WINDOW w AS (PARTITION BY id ORDER BY i)),
z AS (SELECT *, sum(s) OVER (PARTITION BY id ORDER BY i) AS run FROM y),
own AS (SELECT id, string_agg(b, chr(10) ORDER BY i) FILTER (WHERE lv = 0 AND NOT (coalesce(nxt, 0) > lv AND regexp_matches(b, '(?i)(wrote|writes|schrieb|écrit|escribió)[ \t]*:[ \t]*$'))) AS t, max(lv) AS top FROM z GROUP BY id),
o AS (SELECT id, conv_id, turn, role, CASE WHEN text IS NULL THEN NULL WHEN top = 0 THEN text ELSE regexp_replace(regexp_replace(coalesce(t, ''), '^\s+|\s+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') END AS text FROM m JOIN own USING (id)),
runs AS (SELECT id, run, lv, string_agg(b, chr(10) ORDER BY i) AS b FROM z WHERE lv > 0 GROUP BY id, run, lv),
parts AS (SELECT id, lv, b, 'q' AS k FROM runs UNION ALL SELECT id, 0, coalesce(text, ''), 's' FROM o),
grains AS (SELECT id, k, lv, 0 AS g, b AS p FROM parts UNION ALL SELECT id, k, lv, 1, unnest(string_split_regex(b, '\r?\n[ \t]*\r?\n')) FROM parts UNION ALL SELECT id, k, lv, 2, unnest(string_split_regex(b, '\r?\n')) FROM parts),
n AS (SELECT conv_id, turn, k, lv, g, lower(regexp_replace(regexp_replace(p, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS p FROM grains JOIN m USING (id) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
f AS (SELECT conv_id, p, min(turn) AS up FROM n WHERE k = 's' AND length(p) >= CASE WHEN g = 0 THEN 1 ELSE 12 END GROUP BY conv_id, p),
links AS (SELECT n.conv_id, n.turn, -(min({'lv': lv, 'g': g, 'b': -up}).b) AS parent_turn FROM n JOIN f ON f.conv_id = n.conv_id AND f.p = n.p WHERE k = 'q' AND length(n.p) >= CASE WHEN g = 0 THEN 1 ELSE 12 END AND up < n.turn GROUP BY n.conv_id, n.turn),
walk AS (SELECT conv_id, turn, parent_turn AS up, 1 AS depth FROM links UNION ALL SELECT w.conv_id, w.turn, l.parent_turn, w.depth + 1 FROM walk w JOIN links l ON l.conv_id = w.conv_id AND l.turn = w.up),
ends AS (SELECT conv_id, turn, min(up) AS root_turn, max(depth) AS depth FROM walk GROUP BY conv_id, turn),
q AS (SELECT id, count(*) AS n FROM runs GROUP BY id)
SELECT o.conv_id, o.turn, o.role, o.text, coalesce(q.n, 0) AS n_quotes, links.parent_turn, coalesce(root_turn, o.turn) AS root_turn, CAST(coalesce(depth, 0) AS BIGINT) AS depth,
       '<|' || coalesce(o.role, '') || '|>' || chr(10) || coalesce(o.text, '') AS formatted
FROM o LEFT JOIN q USING (id) LEFT JOIN links ON links.conv_id = o.conv_id AND links.turn = o.turn LEFT JOIN ends ON ends.conv_id = o.conv_id AND ends.turn = o.turn
"""
