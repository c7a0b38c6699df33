"""Repair of conversations by fewest edits, with block tables after the Four Russians."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm.common import parallelism, slices, step, table
from hearsay.operators import skew

# a repaired conversation is (s?(ua)+)?: nothing yet, a system turn, a user turn that waits for its answer, an answer
STATES = 4
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GIVEN = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))  # the role an insert or a new role has in each state
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
ROLES = "sua"  # any other initial is the fourth
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
KINDS = 9  # a row to delete; four initials, each whole or truncated
BLOCK = 4
RUN_ROWS = 4096
SPACES = " \t\n\x0b\x0c\r"


def _closed(cost: list[float]) -> tuple[float, ...]:
    """Inserted turns allowed before what comes next."""
    for _ in range(STATES):
        cost = [min(c, INSERT + cost[GIVEN[s][1]]) for s, c in enumerate(cost)]
    return tuple(cost)


def _without(ahead: tuple[float, ...], kind: int) -> list[dict[str, tuple[float, int]]]:
    """Per state what each edit of a row costs from here to the end, and the state behind it."""
    role, cut = ("suax"[(kind - 1) // 2], CUT_OFF * ((kind - 1) % 2)) if kind else ("", 0)
    out = []
    for s in range(STATES):
        edits = {"D": (DELETE + ahead[s], s)}
        if kind:
            if (s, role) in AFTER:
                edits["K"] = (cut + ahead[AFTER[s, role]], AFTER[s, role])
            edits["R"] = (REROLE + cut + ahead[GIVEN[s][1]], GIVEN[s][1])
        out.append(edits)
    return out


class Tables:
    """Costs still to come, by state and less their least, are few vectors; what a block of kinds does to each is a look-up.

    ``end`` is the vector behind the last row. ``one[v, kind]`` and ``block[v, kinds]`` give the vector before a row or before ``BLOCK``
    rows and how much its least grew. ``edits[v, kind, state]`` are the letters that lead over a row whose vector behind it is v,
    and the state then: of the cheapest edits those of the least letter first. Every letter leads from a state to
    one state, so taking the least letter at each step gives the least string, ties included.
    """

    def __init__(self) -> None:
        self.end, self.tail, self.edits = 0, [], {}
        last = [0.0 if s in (0, 3) else float("inf") for s in range(STATES)]
        self.vectors = [_closed(last)]
        for s in range(STATES):  # turns inserted behind the last row
            at, letters = s, ""
            while last[at]:
                at, letters = GIVEN[at][1], letters + "I"
            self.tail.append(letters)
        number, todo, moves = {self.vectors[0]: 0}, deque([0]), {}
        while todo:
            v = todo.popleft()
            for kind in range(KINDS):
                options = _without(self.vectors[v], kind)
                cost = _closed([min(c for c, _ in o.values()) for o in options])
                least = min(cost)
                normal = tuple(c - least for c in cost)
                if normal not in number:
                    number[normal] = len(self.vectors)
                    self.vectors.append(normal)
                    todo.append(number[normal])
                moves[v, kind] = number[normal], int(least)
                for s in range(STATES):
                    self.edits[v, kind, s] = self._letters(options, cost, s)
        n = len(self.vectors)
        self.one = np.array([[moves[v, k][0] for k in range(KINDS)] for v in range(n)])
        self.grown = np.array([[moves[v, k][1] for k in range(KINDS)] for v in range(n)])
        self.block = np.empty((n, KINDS**BLOCK), dtype=np.int32)
        self.block_grown = np.empty_like(self.block)
        for code, kinds in enumerate(product(range(KINDS), repeat=BLOCK)):
            v, grown = np.arange(n), np.zeros(n, dtype=np.int64)
            for kind in reversed(kinds):
                grown += self.grown[v, kind]
                v = self.one[v, kind]
            self.block[:, code], self.block_grown[:, code] = v, grown

    @staticmethod
    def _letters(options: list, cost: tuple[float, ...], s: int) -> tuple[str, int]:
        letters = ""
        while True:
            edits = {**options[s], "I": (INSERT + cost[GIVEN[s][1]], GIVEN[s][1])}
            letter = min(e for e, (c, _) in edits.items() if c == cost[s])
            letters, s = letters + letter, edits[letter][1]
            if letter != "I":
                return letters, s

    def solve(self, kinds: np.ndarray) -> tuple[int, str]:
        """The least cost of a conversation and, of the cheapest edits, the least letters."""
        head = len(kinds) % BLOCK
        codes = kinds[head:].reshape(-1, BLOCK) @ KINDS ** np.arange(BLOCK - 1, -1, -1)
        behind = np.empty(len(codes), dtype=np.int32)  # the vector behind each block
        v, cost = self.end, 0
        for i in range(len(codes) - 1, -1, -1):
            behind[i] = v
            cost += int(self.block_grown[v, codes[i]])
            v = self.block[v, codes[i]]
        # every block expands backward from the vector behind it, all blocks at once
        inside = np.empty((len(codes), BLOCK), dtype=np.int32)
        at = behind
        for j in range(BLOCK - 1, -1, -1):
            inside[:, j] = at
            at = self.one[at, kinds[head + j :: BLOCK][: len(codes)]]
        first = []
        for j in range(head - 1, -1, -1):
            first.append(v)
            cost += int(self.grown[v, kinds[j]])
            v = self.one[v, kinds[j]]
        state, letters = 0, []
        for v_behind, kind in zip([*map(int, reversed(first)), *inside.ravel().tolist()], kinds.tolist(), strict=True):
            edit, state = self.edits[v_behind, kind, state]
            letters.append(edit)
        return cost + int(self.vectors[v][0]), "".join(letters) + self.tail[state]


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with the damage that a checksum of "conv_id:turn" gives each row.

    Nulls of role and text are one space, and so are those of id and turn in the checksum. Of 20 remainders 0 drops the
    row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it and 4 makes it the user's.
    """
    space = F.lit(" ")
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    named = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    rows = conversations.select(
        conv.alias("conv_id"), turn.alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"), (F.crc32(named.cast("binary")) % 20).alias("harm"),
    )
    harm = F.col("harm")
    return rows.filter(harm != 0).select(
        "conv_id", "turn", F.when(harm == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(harm == 1, F.lit("")).when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """All rows in order of conversation, turn, role and text: ``part`` and ``inside`` give the place, ``code`` initial and fault."""
    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.select(*order).repartitionByRange(parallelism(rows.sparkSession), *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("part", F.spark_partition_id())

    def place(batches):
        done = 0
        for batch in batches:
            yield batch.append_column("inside", pa.array(np.arange(done, done + batch.num_rows)))
            done += batch.num_rows

    placed = ranged.mapInArrow(place, "conv_id long, turn long, role string, text string, part int, inside long")
    # a row's text within its conversation, as two hashes; hashing skips nulls, so they are flagged
    own = [F.col("conv_id").isNull(), "conv_id", "role", "text"]
    placed = placed.withColumn("h1", F.xxhash64(*own)).withColumn("h2", F.xxhash64(F.lit("again"), *own[::-1]))
    return step(placed, "turns")


def coded(rows: DataFrame) -> DataFrame:
    """``(conv_id, part, inside, turn, code)``: the first fault of every row and its role's initial, as one letter."""
    place = F.struct("part", "inside")
    first = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    seen = skew.lookup_join(rows, step(first, "first"), ["h1", "h2"], spread_by=["part", "inside"])
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    fault = (
        F.when(last == "", BLANK).when(F.col("first") < place, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    )
    initial = F.instr(F.lit(ROLES), F.substring("role", 1, 1))
    role = F.when(F.length("role") == 0, 3).when(initial > 0, initial - 1).otherwise(3)
    return seen.select("conv_id", "part", "inside", "turn", F.chr((F.lit(65) + role * 4 + fault).cast("long")).alias("code"))


PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = np.zeros(16, dtype=bool)
LEGAL[[0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]] = True  # su, ua, au


def _planned(conv: int | None, codes: bytes, low: int | None, high: int | None, turns: int) -> tuple:
    code = np.frombuffer(codes, dtype=np.uint8).astype(np.int64) - 65
    role, fault = code >> 2, code & 3
    kinds = np.where((fault == BLANK) | (fault == DUPLICATE), 0, 1 + 2 * role + (fault == TRUNCATED))
    cost, audit = tables().solve(kinds)
    count = np.bincount(fault, minlength=4).tolist()
    illegal = int((~LEGAL[role[:-1] * 4 + role[1:]]).sum()) if len(role) else 0
    gaps = 0 if low is None else high - low + 1 - turns
    return conv, gaps, count[BLANK], count[DUPLICATE], count[TRUNCATED], illegal, cost, audit


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of codes in order, conversation by conversation, to one row each."""
    names = [c.split()[0] for c in PLAN.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    begun, conv, codes, low, high, distinct, out, held = False, None, bytearray(), None, None, 0, [], 0
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("conv_id", "part", "codes", "turns")]
        for own, part, run, turns in zip(*columns, strict=True):
            if part < 0:  # the head of a conversation
                if begun:
                    out.append(_planned(conv, bytes(codes), low, high, distinct))
                    held += len(out[-1][-1])
                begun, conv, codes, low, high, distinct = True, own, bytearray(), None, None, 0
                continue
            codes += run.encode()
            known = np.array([t for t in turns if t is not None], dtype=np.int64)
            if len(known):
                distinct += int((known[1:] != known[:-1]).sum()) + (high is None or int(known[0]) != high)
                low, high = int(known[0]) if low is None else low, int(known[-1])
        if len(out) >= 1000 or held > 1 << 20:
            yield packed(out)
            out, held = [], 0
    if begun:
        out.append(_planned(conv, bytes(codes), low, high, distinct))
    if out:
        yield packed(out)


def planned(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Per conversation its faults, the least cost of its repair and the letters of the edits."""
    runs = coded(rows).groupBy("conv_id", "part", F.floor(F.col("inside") / RUN_ROWS).alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("inside", "code", "turn"))).alias("rows")  # at most RUN_ROWS
    )
    runs = runs.select("conv_id", "part", "run", F.array_join(F.col("rows.code"), "").alias("codes"), F.col("rows.turn").alias("turns"))
    heads = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(
        "conv_id", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("run"), F.lit("").alias("codes"),
        F.array().cast("array<bigint>").alias("turns"),
    )
    together = heads.unionByName(runs).repartition("conv_id").sortWithinPartitions("conv_id", "part", "run")
    return together.mapInArrow(_plans, PLAN)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(head, None)`` for each conversation and then ``(edit, role, text)`` for each turn that it keeps or gets, in order."""
    letters: Iterator[str] = iter("")
    state = 0
    for batch in batches:
        for part in slices(batch, "text"):
            for head, role, text in zip(*(part[c].to_pylist() for c in ("plan", "role", "text")), strict=True):
                if head is not None:
                    for edit in letters:  # only inserts are left
                        given, state = GIVEN[state]
                        yield edit, given, ""
                    yield head, None, None
                    letters, state = iter(head["audit"]), 0
                    continue
                for edit in letters:
                    if edit == "D":
                        break
                    if edit == "K":
                        state = AFTER[state, role[0]]
                        yield edit, role, text
                        break
                    given, state = GIVEN[state]
                    yield edit, given, text if edit == "R" else ""
                    if edit == "R":
                        break
    for edit in letters:
        given, state = GIVEN[state]
        yield edit, given, ""


def _in_order(rows: DataFrame, plans: DataFrame) -> DataFrame:
    heads = plans.select(
        "conv_id", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("inside"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), F.struct(*plans.columns).alias("plan"),
    )
    turns = rows.select("conv_id", "part", "inside", "role", "text", F.lit(None).cast(heads.schema["plan"].dataType).alias("plan"))
    together = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "part", "inside")
    return together.select("plan", "role", "text")


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: the turns of all repaired conversations."""

    def run(batches):
        conv, place, out, held = None, 0, [], 0
        for edit, role, text in _lines(batches):
            if role is None:
                conv, place = edit["conv_id"], 0
                continue
            out.append((conv, place, edit, role, text))
            place, held = place + 1, held + len(text)
            if len(out) >= 4096 or held > 8 << 20:
                yield packed(out)
                out, held = [], 0
        if out:
            yield packed(out)

    def packed(out):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "place", "edit", "role", "text"])

    return _in_order(rows, plans).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def digested(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``plans`` with ``repaired_sha256`` of the repaired turns, ``role:text`` each, joined by newlines.

    A digest is one running sum over the whole of a conversation, so a task reads that in order; it holds one row of it at a time.
    """
    columns = plans.columns

    def packed(out):
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [*columns, "repaired_sha256"])

    def run(batches):
        head, digest, between, out, held = None, None, b"", [], 0
        for edit, role, text in _lines(batches):
            if role is None:
                if head is not None:
                    out.append((*head.values(), digest.hexdigest()))
                    held += len(head["audit"])
                head, digest, between = edit, hashlib.sha256(), b""
                if len(out) >= 4096 or held > 8 << 20:
                    yield packed(out)
                    out, held = [], 0
                continue
            digest.update(between + role.encode() + b":")
            digest.update(text.encode())
            between = b"\n"
        if head is not None:
            out.append((*head.values(), digest.hexdigest()))
        if out:
            yield packed(out)

    return _in_order(rows, plans).mapInArrow(run, PLAN + ", repaired_sha256 string")


def repair(conversations: DataFrame, damage: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(rows, plans)``: the turns in order, and what each conversation lacks and needs.

    Rows of a conversation are taken by turn (nulls first), then role and text; equal rows follow one another. Each
    row's first fault counts: blank, a duplicate of an earlier row's role and text, truncated (its last character that
    is no white space is not one of ``.!?``). Keeping a row costs 0, giving it the role that is due 1, deleting it 2 (blank
    rows and duplicates must go), inserting an empty turn 5, and a truncated row that stays 5 more. The cheapest edits that give
    ``(s?(ua)+)?`` are found, of equally cheap ones those whose letters come first (D, I, K, R).

    Costs to the end of a conversation, by state of that pattern, are few vectors once their least is taken off; a table
    made once holds what every block of four rows does to every vector. A conversation takes one look-up a block from its
    last to its first; then all blocks expand backward from the vector behind each, and the letters follow from the front.

    Null ids are one conversation; an empty role, like an unknown one, has no place in the pattern. Conversations that lose all rows stay, without faults or
    edits. Other columns are ignored; no rows give no rows. Rows are range-sorted, so a conversation of any length is
    cut; its first copies are found by keys combined before they are shuffled and joined by ``skew.lookup_join``. A task then reads
    it in order as one letter a row, which is as long as its audit, one value of the result.
    """
    rows = ordered(damaged(conversations) if damage else conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    ))
    return rows, step(planned(conversations, rows), "plans")


def op13_conversations(spark: SparkSession, sf: str) -> DataFrame:
    rows, plans = repair(table(spark, sf, "conversations"))
    return digested(rows, plans)


def _option(letter: str, cost: str, behind: str, allowed: str = "true") -> str:
    return f"case when {allowed} then {{'c': {behind}.c + {cost}, 'a': '{letter}' || {behind}.a}} else {{'c': 1000000000, 'a': ''}} end"


def _best(state: int) -> str:
    """SQL for the cheapest letters over one row and to the end, without inserts before the row."""
    options = [_option("D", "2", f"b{state}"), _option("R", "1 + cut", f"b{GIVEN[state][1]}", "not must")]
    options += [_option("K", "cut", f"b{to}", f"not must and role[1] = '{role}'") for (s, role), to in AFTER.items() if s == state]
    return f"list_min([{', '.join(options)}]) as w{state}"


# a checksum as in zlib (each byte is followed by eight steps of the shift register), then costs and letters from the last row to the first
SQL = f"""
with recursive k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name
  from conversations),
h as (
  select *, xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(name, ''), lambda x: [ord(x), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, (c & 1) * 3988292384) end)) % 20 as harm
  from k),
r as (
  select conv_id, turn, case when harm = 4 then 'user' else role end as role,
         case harm when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case harm when 0 then [] when 3 then [0, 1] else [0] end) as copy
  from h),
o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, count(*) over (partition by conv_id) as n,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare
  from r),
f as (
  select *, case when bare = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
                 when bare[-1] not in ('.', '!', '?') then 'truncated' else '' end as fault,
         lag(role[1]) over (partition by conv_id order by i) || role[1] as pair
  from o),
g as (select *, fault in ('blank', 'duplicate') as must, case when fault = 'truncated' then 5 else 0 end as cut from f),
t as (
  select conv_id, n + 1 as i, {{'c': 0, 'a': ''}} as b0, {{'c': 10, 'a': 'II'}} as b1, {{'c': 5, 'a': 'I'}} as b2, {{'c': 0, 'a': ''}} as b3
  from g where i = n
  union all
  select conv_id, i, list_min([w0, {{'c': v2.c + 5, 'a': 'I' || v2.a}}]), list_min([w1, {{'c': v2.c + 5, 'a': 'I' || v2.a}}]), v2, v3
  from (
    select *, list_min([w2, {{'c': w3.c + 5, 'a': 'I' || w3.a}}]) as v2, list_min([w3, {{'c': w2.c + 5, 'a': 'I' || w2.a}}]) as v3
    from (
      select g.conv_id, g.i, {', '.join(_best(s) for s in range(STATES))}
      from t join g on g.conv_id is not distinct from t.conv_id and g.i = t.i - 1) x) y),
p as (select conv_id, b0.c as cost, b0.a as audit from t where i = 1),
l as (select conv_id, unnest(string_split(audit, '')) as letter, unnest(range(1, length(audit) + 1)) as j from p where audit <> ''),
m as (select *, sum(cast(letter <> 'I' as int)) over (partition by conv_id order by j) as i from l),
q as (
  select m.conv_id, letter, g.role, g.text, row_number() over (partition by m.conv_id order by j) as place
  from m left join g on g.conv_id is not distinct from m.conv_id and g.i = m.i and letter <> 'I' where letter <> 'D'),
s as (select *, place - max(cast(place = 1 and letter = 'K' and role[1] = 's' as int)) over (partition by conv_id) as beat from q),
d as (
  select conv_id, sha256(string_agg(case when letter = 'K' then role when beat % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''),
                                    chr(10) order by place)) as sha
  from s group by conv_id),
c as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
         count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from g group by conv_id)
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, cast(coalesce(cost, 0) as bigint) as cost, coalesce(audit, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) a
left join c on c.conv_id is not distinct from a.conv_id left join p on p.conv_id is not distinct from a.conv_id
left join d on d.conv_id is not distinct from a.conv_id"""

QUERIES = {"op13_conversations": op13_conversations}
ORACLES = {"op13_conversations": SQL}
