"""Chat formatting in budgeted windows, with DataFrame functions alone.

A conversation's turns are laid along a line by prefix sums of their tokens. The line is cut in cells of the budget that is
left for new turns; a turn inside a cell belongs to the cell's window, a turn that straddles a border has a window of its own. So every
window holds whole turns, and no window's new turns exceed the budget unless a single turn does. A window begins with the
conversation's system turn, then repeats the turns that lie within the history budget before it, then brings its new turns. The
loss mask covers the assistant texts among the new turns only: repeated ones are masked.

A turn is written as HEAD role newline text TAIL. In roles and texts a backslash is doubled, and the first sign of each control
string is followed by a backslash (as is a newline in a role), so no control string is left inside; dropping the backslash of
each backslash pair restores the text.

Edge cases: null texts and roles are empty; turns of one number are ordered by role, then text, a null number comes first; a
null conv_id is a conversation of its own; an empty turn costs the turn's overhead; only a first turn may be the system turn;
a system turn that fills the budget leaves a quarter of it for new turns; long texts stay whole; repeated rows are
repeated turns; an empty table gives an empty table; extra columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, TAIL = "<|im_start|>", "<|im_end|>\n"
#: Strings that no text may bring into the output.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Tokens of a window, tokens of history in it, tokens that a turn's marks cost.
BUDGET, HISTORY, OVERHEAD = 1024, 256, 4
_SYSTEM, _ASSISTANT = "system", "assistant"


def escape(text: Column) -> Column:
    """The text without control strings."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """What escape() was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    """A native count of tokens: runs of letters in fours, digits and other signs."""
    return F.regexp_count(text, F.lit(r"\p{L}{1,4}|\p{N}|[^\s\p{L}\p{N}]"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """A row per window: conv_id, window, formatted text, number of repeated turns at its head, number of turns, loss spans and segments.

    A loss span (start, length) counts code points of the formatted text and covers an assistant text without its marks.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    escaped_role = F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))
    turns = conversations.select(
        F.col("conv_id").alias("conv"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.concat(F.lit(HEAD), escaped_role, F.lit("\n")).alias("head"),
        escape(text).alias("body"),
        (tokens(text) + OVERHEAD).cast("bigint").alias("cost"),
    )
    by = Window.partitionBy("conv")
    line = by.orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumns({"pos": F.row_number().over(by.orderBy("turn", "role", "text")).cast("bigint"), "stop": F.sum("cost").over(line)})
    is_system = (F.col("pos") == 1) & (F.col("role") == _SYSTEM)
    turns = turns.withColumns({"system": is_system, "start": F.col("stop") - F.col("cost")})
    turns = turns.withColumn("system_cost", F.sum(F.when(F.col("system"), F.col("cost")).otherwise(0)).over(by))
    room = F.greatest(F.lit(budget) - F.lit(history) - F.col("system_cost"), F.lit(budget // 4))
    # The line of new turns starts after the system turn.
    turns = turns.withColumns({"start": F.col("start") - F.col("system_cost"), "stop": F.col("stop") - F.col("system_cost"), "room": room})
    cell, last = F.floor(F.col("start") / F.col("room")), F.floor((F.col("stop") - 1) / F.col("room"))
    turns = turns.withColumn("window", F.when(F.col("system"), F.lit(-1)).when(cell == last, cell * 2).otherwise(cell * 2 + 1).cast("bigint"))
    opens = F.coalesce(F.lag("window").over(by.orderBy("pos")) != F.col("window"), F.lit(True)) & ~F.col("system")
    turns = turns.withColumn("opens", opens)
    # The windows that begin within the history budget after a turn's start repeat it.
    ahead = by.orderBy("start").rangeBetween(1, history)
    repeats = F.when(~F.col("system"), F.collect_list(F.when(F.col("opens"), F.col("window"))).over(ahead)).otherwise(F.lit(None))
    turns = turns.withColumn("into", F.concat(F.array("window"), F.coalesce(repeats, F.expr("array()").cast("array<bigint>"))))
    columns = ("conv", "window", "pos", "role", "head", "body", "again")
    placed = turns.filter(~F.col("system")).withColumnRenamed("window", "own").select("*", F.explode("into").alias("window")).withColumn("again", F.col("own") != F.col("window")).select(*columns)
    # The system turn goes into every window; it is new in the first one, or in a window of its own if nothing else is there.
    opened = turns.filter("opens").select(F.col("conv").alias("oconv"), F.col("window").alias("owindow"), (F.col("start") > 0).alias("oagain"))
    kept = turns.filter("system").drop("window").join(opened, F.col("conv").eqNullSafe(F.col("oconv")), "left")
    kept = kept.withColumns({"window": F.coalesce("owindow", F.lit(0).cast("bigint")), "again": F.coalesce("oagain", F.lit(False))}).select(*columns)
    laid = placed.unionByName(kept)
    size = F.length("head") + F.length("body") + len(TAIL)
    before = F.sum(size).over(Window.partitionBy("conv", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    laid = laid.withColumn("at", before)
    target = (F.col("role") == _ASSISTANT) & ~F.col("again")
    part = F.struct("pos", F.concat("head", "body", F.lit(TAIL)).alias("written"), F.when(target, F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("bigint").alias("length"))).alias("loss"))
    made = laid.groupBy("conv", "window").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.count_if(F.col("again")).alias("n_repeated"), F.count("*").alias("n_turns"))
    loss = F.filter(F.transform("parts", lambda p: p["loss"]), lambda x: x.isNotNull())
    return made.select(F.col("conv").alias("conv_id"), "window", F.array_join(F.transform("parts", lambda p: p["written"]), "").alias("formatted"), "n_repeated", "n_turns", loss.alias("loss_spans"))


def read_back(frame: DataFrame) -> DataFrame:
    """The new turns (role, text) of each window and the text under its loss mask, from the formatted text and the window's numbers."""
    pieces = F.slice(F.split("formatted", TAIL.replace("|", r"\|")), F.col("n_repeated").cast("int") + 1, (F.col("n_turns") - F.col("n_repeated")).cast("int"))

    def turn(piece: Column) -> Column:
        role = F.regexp_extract(piece, r"(?s)^" + HEAD.replace("|", r"\|") + r"((?:[^\\\n]|\\.)*+)\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(piece, F.length(role) + len(HEAD) + 2)).alias("text"))

    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return frame.select("conv_id", "window", F.transform(pieces, turn).alias("turns"), masked.alias("loss_text"), F.length("formatted").alias("chars"))


def digests(frame: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows."""
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read_back(frame).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", listed.alias("listed"), "loss_text"))).alias("w"), F.sum(F.size("turns")).alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    turns, loss = F.array_join(F.col("w.listed"), ""), F.array_join(F.col("w.loss_text"), "")
    return rows.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows")


def example(conversations: DataFrame) -> DataFrame:
    """Conversation -1, whose texts hold control strings."""
    return conversations.sparkSession.sql("SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'")


def _sql() -> str:
    escaped = "replace({}, '\\', '\\\\')"
    for c in CONTROL:
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\{c[1:]}')"
    body, role = escaped.format("text"), f"replace({escaped.format('role')}, chr(10), '\\' || chr(10))"
    return f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
costed AS (
  SELECT *, length({body}) + length({role}) + {len(HEAD) + 1 + len(TAIL)} AS size,
    len(regexp_extract_all(text, '\\p{{L}}{{1,4}}|\\p{{N}}|[^\\s\\p{{L}}\\p{{N}}]')) + {OVERHEAD} AS cost FROM given),
numbered AS (
  SELECT *, row_number() OVER o AS pos, sum(cost) OVER (o ROWS UNBOUNDED PRECEDING) AS stop FROM costed
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
marked AS (
  SELECT *, pos = 1 AND role = '{_SYSTEM}' AS sys, coalesce(sum(CASE WHEN pos = 1 AND role = '{_SYSTEM}' THEN cost END) OVER (PARTITION BY conv_id), 0) AS sys_cost FROM numbered),
lined AS (
  SELECT *, stop - cost - sys_cost AS a, stop - sys_cost AS b, greatest({BUDGET - HISTORY} - sys_cost, {BUDGET // 4}) AS room FROM marked),
celled AS (
  SELECT *, CASE WHEN a // room = (b - 1) // room THEN 2 * (a // room) ELSE 2 * (a // room) + 1 END AS win FROM lined),
opened AS (SELECT conv_id, win, min(a) AS w FROM celled WHERE NOT sys GROUP BY ALL),
laid AS (
  SELECT c.conv_id, sum(c.size) AS chars, 0 AS n FROM celled c JOIN opened o ON c.conv_id IS NOT DISTINCT FROM o.conv_id AND NOT c.sys AND (c.win = o.win OR o.w - c.a BETWEEN 1 AND {HISTORY}) GROUP BY ALL
  UNION ALL SELECT c.conv_id, sum(c.size), 0 FROM celled c LEFT JOIN opened o ON c.conv_id IS NOT DISTINCT FROM o.conv_id WHERE c.sys GROUP BY ALL),
chars AS (SELECT conv_id, sum(chars) AS formatted_chars FROM laid GROUP BY ALL),
counted AS (SELECT conv_id, count(*) AS n_windows FROM opened GROUP BY ALL),
joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS turns,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = '{_ASSISTANT}'), '') AS loss FROM numbered GROUP BY ALL)
SELECT j.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, coalesce(n_windows, 1) AS n_windows
FROM joined j LEFT JOIN chars c ON j.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN counted w ON j.conv_id IS NOT DISTINCT FROM w.conv_id
"""


SQL = _sql()
