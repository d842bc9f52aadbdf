"""Conversation repair: the cheapest edits that give a conversation the roles (s?(ua)+)?.

Retained-subsequence dynamic program. A turn is deleted, or it is retained in the role u or a (its own, or by a
rerole), or in its own role s at the front. Prefix sums of deletion costs price the gap between two retained turns,
a running minimum for each role of the last retained turn stands for all places where the gap may begin, and the pair
of roles says what must be inserted between them. Equal costs are settled by the least audit. Before a retained turn
come deletions, then inserts, since D < I: so audits that cover the same turns never are prefixes of each other, and
comparing what there is so far settles what comes later.

That makes the program a product of small matrices, (role before, role after) -> (cost, audit), and a conversation of
any length can be cut. Turns are range-partitioned by conversation, turn, role and text, so that one with a third of all
rows spreads over many tasks, and each task packs its sorted turns in pieces of at most PIECE turns. A piece that holds a
whole conversation (nearly all do) is settled on the spot. The others tell their matrices; one task per such conversation
folds these (a few numbers a piece), and each piece is then told the roles it starts and ends with. Equal rows are
one row with a count before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm.cut import cut, hidden

PIECE, PIECE_BYTES, PREFIX = 512, 4 << 20, 64
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Costs of the edits, roles by their initials, turns that a pair of neighbouring retained roles needs
#: between them ("" is the start), and those that the end needs.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
ROLES = {"u": "user", "a": "assistant"}
BETWEEN = {("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "u"): "a", ("u", "a"): "", ("a", "u"): "", ("a", "a"): "u"}
ENDING = {"": "", "s": "ua", "u": "a", "a": ""}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

Row = tuple[str, bool, bool]  # initial, must go, truncated
Ends = dict[str, tuple[int, str]]  # role of the last retained turn: (cost, audit)


def paths(rows: Sequence[Row], start: str = "") -> Ends:
    """The cheapest edits of rows for each role that they can end with, if `start` is the role before them."""
    gone = 0  # prefix sum of deletion costs
    least: Ends = {start: (0, "")}  # cost less the prefix sum where the gap began
    for initial, must_go, truncated in rows:
        retained: Ends = {}
        if not must_go:
            for role in ("s", "u", "a") if initial == "s" else ("u", "a"):
                own = role == initial
                found = [
                    (cost + gone + INSERT * len(BETWEEN[p, role]) + (0 if own else REROLE) + truncated * TRUNCATED, audit + "I" * len(BETWEEN[p, role]) + "RK"[own])
                    for p, (cost, audit) in least.items() if (p, role) in BETWEEN
                ]
                if found:
                    retained[role] = min(found)
        gone += DELETE
        least = {p: (cost, audit + "D") for p, (cost, audit) in least.items()}
        for role, (cost, audit) in retained.items():
            least[role] = min(least.get(role, (cost - gone + 1, "")), (cost - gone, audit))
    return {p: (cost + gone, audit) for p, (cost, audit) in least.items()}


def best_end(ends: Ends) -> tuple[int, str, str]:
    """(cost, audit, role before the end) of the cheapest way to end."""
    return min((cost + INSERT * len(ENDING[p]), audit + "I" * len(ENDING[p]), p) for p, (cost, audit) in ends.items())


def apply(audit: str, turns: Sequence[tuple[str, str]], copies: Sequence[int], start: str, ends: bool) -> tuple[str, list[tuple[str, str]]]:
    """(audit with a letter for every copy, repaired turns) of the piece's audit after the role `start`. The roles of
    inserted and reroled turns follow from what comes next; `ends`: the conversation ends here."""
    letters, out, i, before, pending = [], [], 0, start, 0
    for x in audit:
        if x == "I":
            pending += 1
            letters.append(x)
            continue
        role, text = turns[i]
        if x != "D":
            needed = next(r for r in ([role[:1]] if x == "K" else ["u", "a"]) if (before, r) in BETWEEN and len(BETWEEN[before, r]) == pending)
            out += [(ROLES[r], "") for r in BETWEEN[before, needed]]
            out.append((role if x == "K" else ROLES[needed], text))
            before, pending = needed, 0
        letters.append(x + "D" * (copies[i] - 1))
        i += 1
    if ends:
        out += [(ROLES[r], "") for r in ENDING[before]]
    return "".join(letters), out


def _blank(text: str) -> bool:
    return not text.strip(SPACE)


def _truncated(text: str) -> bool:
    return text.rstrip(SPACE)[-1:] not in (".", "!", "?")


def _facts(turns: Sequence[tuple[str, str]], copies: Sequence[int], again: Sequence[bool]) -> tuple[list[Row], dict[str, int]]:
    """Rows for the program, and the counts of faults and deleted copies of a piece. again: seen earlier."""
    rows, n = [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "extra": 0}
    before = None
    for (role, text), m, seen in zip(turns, copies, again, strict=True):
        blank = _blank(text)
        cut_off = not blank and not seen and _truncated(text)
        rows.append((role[:1], blank or seen, cut_off))
        n["blank"] += m * blank
        n["duplicate"] += 0 if blank else m if seen else m - 1
        n["truncated"] += cut_off
        n["extra"] += DELETE * (m - 1)
        n["illegal"] += m - 1 + (before is not None and (before, role[:1]) not in LEGAL)
        before = role[:1]
    return rows, n


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_TURN = "array<struct<role: string, text: string>>"
_ARROW_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def damaged(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """df's four columns after seeded damage, and `copies` of each row, 0 for those that are dropped.

    By the CRC-32 of `conversation:turn` modulo 20 a row is dropped (0), its text emptied (1) or robbed of its `[.!?]`
    (2), the row repeated (3), or its role set to user (4). Nulls in role, text and the hashed string are one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(said(conversation), F.lit(":"), said(turn)).cast("binary")) % 20
    new = F.when(case <= 1, F.lit("")).when(case == 2, F.regexp_replace(said(text), "[.!?]", "")).otherwise(said(text))
    copies = F.when(case == 0, 0).when(case == 3, 2).otherwise(1).cast("bigint")
    return df.select(F.col(conversation), F.col(turn), F.when(case == 4, F.lit("user")).otherwise(said(role)).alias(role), new.alias(text), copies.alias("copies"))


def _combined(rows: DataFrame) -> DataFrame:
    """Equal rows of a batch as one with the sum of their copies; those without copies lose their turn."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            g = t.group_by(["conv", "turn", "role", "text"]).aggregate([("copies", "sum")]).rename_columns(["conv", "turn", "role", "text", "copies"])
            yield from g.select(b.schema.names).cast(b.schema).to_batches()

    return rows.mapInArrow(combine, rows.schema)


def pieces(df: DataFrame, *, conversation: str, turn: str, role: str, text: str, copies: str | None, most: int) -> DataFrame:
    """(conv, part, piece, alone, turns, copies, marks, numbers): sorted turns in pieces of one conversation each.

    alone: the whole conversation is here. marks: a digest of each turn's role and text; numbers: of each turn.
    """
    plain, (c_, t_, r_, x_, *n_) = hidden(df, conversation, turn, role, text, *([copies] if copies else []))
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.coalesce(F.col(n_[0]).cast("bigint"), F.lit(1)) if n_ else F.lit(1).cast("bigint")
    rows = plain.select(F.col(c_).alias("conv"), F.col(t_).cast("bigint").alias("turn"), said(r_).alias("role"), said(x_).alias("text"), n.alias("copies"))
    void = F.col("copies") <= 0
    rows = rows.select("conv", F.when(~void, F.col("turn")).alias("turn"), F.when(void, F.lit("")).otherwise(F.col("role")).alias("role"), F.when(void, F.lit("")).otherwise(F.col("text")).alias("text"), F.when(void, F.lit(0)).otherwise(F.col("copies")).cast("bigint").alias("copies"))
    # range bounds are sampled to the driver, so the keys are short; sorting then compares whole roles and texts
    dealt = _combined(rows).repartitionByRange("conv", "turn", F.substring("role", 1, PREFIX), F.substring("text", 1, PREFIX))
    ordered = dealt.sortWithinPartitions("conv", "turn", "role", "text")
    kind = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *_fields(f"part int, piece int, alone boolean, turns {_TURN}, copies array<bigint>, marks array<binary>, numbers array<bigint>")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, conv, size = TaskContext.get().partitionId(), 0, None, 0
        parts, first = 0, True  # pieces of this conversation so far; whether an earlier task may hold turns of it
        held: list[tuple] = []
        ready: list[dict] = []
        opened, arrow = False, None

        def done(last: bool) -> None:
            nonlocal number, parts, size
            rows = [x for x in held if x[3]]
            turns = [{"role": x[1], "text": x[2]} for x in rows]
            alone = last and not first and not parts
            ready.append({"conv": conv, "part": part, "piece": number, "alone": alone, "turns": turns, "copies": [x[3] for x in rows], "marks": [_digest(x[1], x[2]) for x in rows], "numbers": [x[0] for x in rows]})
            held.clear()
            number, parts, size = number + 1, parts + 1, 0

        for b in batches:
            own = [("turns", _ARROW_TURNS), ("copies", pa.list_(pa.int64())), ("marks", pa.list_(pa.binary())), ("numbers", pa.list_(pa.int64()))]
            arrow = pa.schema([("conv", b.schema.field("conv").type), ("part", pa.int32()), ("piece", pa.int32()), ("alone", pa.bool_()), *own])
            for c, t, r, x, m in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if opened and c != conv:
                    done(True)
                    first, parts = False, 0
                conv, opened = c, True
                if held and held[-1][:3] == (t, r, x):
                    held[-1] = (t, r, x, held[-1][3] + m)
                    continue
                if len(held) >= most or size >= PIECE_BYTES:
                    done(False)
                held.append((t, r, x, m))
                size += len(x)
            yield from pa.Table.from_pylist(ready, arrow).to_batches()
            ready.clear()
        if opened:
            done(False)  # a later task may go on with it
            yield from pa.Table.from_pylist(ready, arrow).to_batches()

    return ordered.mapInArrow(pack, kind)


def _seen(spread: DataFrame) -> DataFrame:
    """spread with `again`: the places of turns that an earlier turn of the conversation equals in role and text."""
    turns = spread.select("conv", "part", "piece", F.posexplode("marks").alias("pos", "mark"))
    place = F.struct("part", "piece", "pos")
    first = turns.groupBy(F.col("conv").alias("_conv"), F.col("mark").alias("_mark")).agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    later = turns.join(first, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("mark") == F.col("_mark"))).where(place != F.col("_first"))
    return spread.join(later.groupBy("part", "piece").agg(F.collect_list("pos").alias("again")), ["part", "piece"], "left")


def _pairs(turns: list[dict]) -> list[tuple[str, str]]:
    return [(x["role"], x["text"]) for x in turns]


def _flags(row: dict) -> list[bool]:
    again = set(row["again"] or ())
    return [i in again for i in range(len(row["turns"]))]


def _matrices(spread: DataFrame) -> DataFrame:
    """(conv, part, piece, ways): for each role before the piece and after it, the least cost and audit."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("p", pa.string()), ("q", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
        for b in batches:
            ways = []
            for r in b.select(["turns", "copies", "again"]).to_pylist():
                rows, _ = _facts(_pairs(r["turns"]), r["copies"], _flags(r))
                ways.append([{"p": p, "q": q, "cost": c, "audit": a} for p in ENDING for q, (c, a) in paths(rows, p).items()])
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("part"), b.column("piece"), pa.array(ways, kind)], ["conv", "part", "piece", "ways"])

    kind = T.StructType([spread.schema["conv"], *_fields("part int, piece int, ways array<struct<p: string, q: string, cost: bigint, audit: string>>")])
    return spread.select("conv", "part", "piece", "turns", "copies", "again").mapInArrow(tell, kind)


def _folded(matrices: DataFrame) -> DataFrame:
    """(part, piece, before, after, share, ends) of the pieces: the roles they start and end with on the cheapest way
    through the conversation, their share of its cost, and whether it ends there.

    Pieces of a conversation come as a sorted stream. For each of them four costs and roles are held, not audits: of
    ways that come to different roles the audits differ, and so their order is all that later choices ask for.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, opened = None, False
        state: dict[str, tuple[int, int]] = {}
        trail: list[tuple] = []

        def done() -> pa.RecordBatch:
            role = min(state, key=lambda q: (state[q][0] + INSERT * len(ENDING[q]), state[q][1]))
            rows, extra, last = [], INSERT * len(ENDING[role]), True
            for part, piece, back in reversed(trail):
                before, share = back[role]
                rows.append((part, piece, before, role, share + extra, last))
                role, extra, last = before, 0, False
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
            names = ["part", "piece", "before", "after", "share", "ends"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for r in b.to_pylist():
                if opened and r["conv"] != conv:
                    yield done()
                if not opened or r["conv"] != conv:
                    conv, opened, state, trail = r["conv"], True, {"": (0, 0)}, []
                best: dict[str, tuple] = {}
                for w in r["ways"]:
                    if w["p"] in state:
                        cost, rank = state[w["p"]]
                        way = (cost + w["cost"], rank, w["audit"], w["p"], w["cost"])
                        best[w["q"]] = min(best.get(w["q"], way), way)
                order = sorted(best, key=lambda q: best[q][1:3])
                state = {q: (best[q][0], i) for i, q in enumerate(order)}
                trail.append((r["part"], r["piece"], {q: best[q][3:] for q in best}))
        if opened:
            yield done()

    rows = matrices.repartition("conv").sortWithinPartitions("conv", "part", "piece")
    return rows.mapInArrow(fold, "part int, piece int, before string, after string, share bigint, ends boolean")


def _settled(rows: DataFrame) -> DataFrame:
    """The edits of pieces: of whole conversations (no column `before`), or of such as _folded() has told their ways."""
    whole = "before" not in rows.columns
    told = f"cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, audit string, repaired {_TURN}, numbers array<bigint>"
    kind = T.StructType([rows.schema["conv"], *_fields(f"part int, piece int, alone boolean, {told}")])
    texts = {"first": pa.string(), "last": pa.string(), "audit": pa.string(), "repaired": _ARROW_TURNS, "numbers": pa.list_(pa.int64())}
    kinds = {"part": pa.int32(), "piece": pa.int32(), "alone": pa.bool_(), **dict.fromkeys(["cost", *COUNTS], pa.int64()), **texts}

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                turns = _pairs(r["turns"])
                if whole:
                    earlier: set[bytes] = set()
                    facts, n = _facts(turns, r["copies"], [m in earlier or earlier.add(m) is not None for m in r["marks"]])
                    before, ends = "", True
                    cost, audit, _ = best_end(paths(facts))
                else:
                    facts, n = _facts(turns, r["copies"], _flags(r))
                    before, ends, cost = r["before"], r["ends"], r["share"]
                    audit = paths(facts, before)[r["after"]][1] + ("I" * len(ENDING[r["after"]]) if ends else "")
                audit, repaired = apply(audit, turns, r["copies"], before, ends)
                initials = [role[:1] for role, _ in turns] or [None]
                made = {"cost": cost + n["extra"], "first": initials[0], "last": initials[-1], "audit": audit, "repaired": [{"role": a, "text": t} for a, t in repaired]}
                out.append({k: r[k] for k in ("conv", "part", "piece", "alone", "numbers")} | {k: n[k] for k in COUNTS} | made)
            yield from pa.Table.from_pylist(out, pa.schema([("conv", b.schema.field("conv").type), *kinds.items()])).to_batches()

    return rows.mapInArrow(settle, kind)


def repair(df: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, most: int = PIECE) -> DataFrame:
    """(conv, part, piece, alone, cost, blank, duplicate, truncated, illegal, first, last, audit, repaired, numbers) of
    each piece of a conversation, in the order of part and piece: its edits and the turns that come out of it.

    Turns are taken by turn (nulls first), then by role and text in code-point order. A turn's first fault counts:
    blank (no character but white space), duplicate (role and text seen earlier), truncated (the last such character
    is none of `.!?`). Nulls in role and text are one space; a null conversation is one of its own. copies says how
    often a row stands (rows that repeat count as well; null: once); a conversation of whose rows all have 0 copies
    gives a piece without turns. A piece has at most `most` turns. Texts are never cut. Other columns are not read. An empty table: no rows.
    """
    whole, several = repaired_pieces(df, conversation=conversation, turn=turn, role=role, text=text, copies=copies, most=most)
    return whole.unionByName(several)


def repaired_pieces(df: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, most: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """What repair() gives, apart: conversations of one piece, and those that may have several."""
    table = cut(pieces(df, conversation=conversation, turn=turn, role=role, text=text, copies=copies, most=most), "conversation-pieces")
    spread = cut(_seen(table.where("NOT alone")), "conversation-spread")
    ways = cut(_folded(_matrices(spread)), "conversation-ways")
    return _settled(table.where("alone")), _settled(spread.join(ways, ["part", "piece"]))


def turns(repaired: DataFrame) -> DataFrame:
    """(conv, part, piece, pos, role, text): the turns of repaired conversations, in the order of part, piece and pos."""
    return repaired.select("conv", "part", "piece", F.posexplode("repaired").alias("pos", "turn")).select("conv", "part", "piece", "pos", "turn.role", "turn.text")


def digests(whole: DataFrame, several: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation
    of repaired_pieces().

    The hash of a conversation's `role:text` lines needs them in order: pieces of one that has several come to one
    task, as a sorted stream, of which only the hash, the counts and the audit are held. Nothing else is shuffled.
    """
    kind = T.StructType([whole.schema["conv"], *_fields("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        schema = None

        def table(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            span = lambda x: 0 if x["low"] is None else x["high"] - x["low"] + 1 - x["distinct"]
            made = [x | {"gaps": span(x), "audit": "".join(x["audit"]), "repaired_sha256": x["hash"].hexdigest()} for x in rows]
            return iter(pa.Table.from_pylist([{k: x[k] for k in schema.names} for x in made], schema).to_batches())

        for b in batches:
            schema = pa.schema([("conv", b.schema.field("conv").type), *[(k, pa.int64()) for k in ["gaps", *COUNTS, "cost"]], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            done = []
            for r in b.to_pylist():
                if now is None or r["conv"] != now["conv"]:
                    done += [now] if now else []
                    now = {"conv": r["conv"], "low": None, "high": None, "distinct": 0, "end": None, "audit": [], "hash": hashlib.sha256(), "any": False, "cost": 0, **dict.fromkeys(COUNTS, 0)}
                for k in ["cost", *COUNTS]:
                    now[k] += r[k]
                if r["first"] is not None:
                    now["illegal"] += now["end"] is not None and (now["end"], r["first"]) not in LEGAL
                    now["end"] = r["last"]
                for number in r["numbers"]:
                    if number is not None and number != now["high"]:
                        now["low"] = number if now["low"] is None else now["low"]
                        now["high"], now["distinct"] = number, now["distinct"] + 1
                now["audit"].append(r["audit"])
                for x in r["repaired"]:
                    now["hash"].update((("\n" if now["any"] else "") + f"{x['role']}:{x['text']}").encode())
                    now["any"] = True
            yield from table(done)
        if now:
            yield from table([now])

    ordered = several.repartition("conv").sortWithinPartitions("conv", "part", "piece")
    return whole.mapInArrow(read, kind).unionByName(ordered.mapInArrow(read, kind))
