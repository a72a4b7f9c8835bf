"""Line dedup: a segment-partition edit join, with DataFrame functions only.

Two lines within ``TAU`` edits share, by the pigeonhole principle, one of TAU + 1 segments of their frame: the head, the
tail, or the middle, which has then moved by one place at most. A frame is the length rounded down, so segments are aware
of lengths, and lines near a frame's edge look into the one below too. Candidates are verified by a bit-parallel edit
distance on the diagonal band of width 2 TAU + 1, after common heads and tails are cut off.

A line goes if an earlier one is near, so one earlier neighbour is enough. In a small group of lines with one key all are
candidates of each other; in a large one each is held against the earliest, the hub, only. Where that leaves lines open,
the group is parted by where each line leaves the hub: of two near lines the one that leaves it later does so within what
the other reaches of the hub with TAU edits, from either side. Parts that are large still are parted once more, by segments
of what is left when the heads and tails that all their lines share are cut off. No step loses a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.llm.workspace import Workspace

#: Edits up to which lines are the same. The keys are made for two: one edit in the head and one in the tail move the middle by one.
TAU = 2
#: Shorter lines (code points, trimmed) are held against equal ones only: any two of them are a few edits apart.
LEAST = 20
#: Lines of a group that are all candidates of each other; larger groups meet by their hub.
SMALL = 8
#: Rows of a part that are compared with each other; a larger part is parted once more.
LARGE = 64
#: Cells of a hub's places.
CELLS = 16
#: Rows of 8 or 16 bytes that are broadcast at most; more are shuffled.
BROADCAST_ROWS = 1_000_000


def _power(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k.cast("int"))


def frame(length: Column) -> Column:
    """The length less all but its three highest bits; lengths below 8 are whole."""
    drop = F.greatest(F.length(F.bin(length.cast("long"))) - 3, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", length.cast("int"), drop), drop)


def segment_keys(text: Column, length: Column, frames: list[Column]) -> Column:
    """Structs (key, kind): head, tail and middle of each frame that is not null; kind 1 is the middle one place on, which kind 0 only may meet.

    The untouched middle has one place more than its key, so both lines' middles are whole if it moved by one.
    """
    keys = []
    for f in frames:
        third = F.floor(f / 3).cast("int")
        parts = ((0, F.lit(1), third, 0), (1, length - (f - 2 * third) + 1, f - 2 * third, 0), (2, third + 1, third - 1, 0), (2, third + 2, third - 1, 1))
        for name, start, size, kind in parts:
            # a frame below 6 has no three segments: its lines all meet
            content = F.when(f >= 6, F.substring(text, start, size)).otherwise(F.lit(""))
            key = F.struct(F.xxhash64(F.lit(name), f, content).alias("key"), F.lit(kind).cast("int").alias("kind"))
            keys.append(F.when(f.isNotNull() & (F.lit(kind == 0) | (f >= 6)), key))
    return F.array_compact(F.array(*keys))


def frames_of(length: Column, names: tuple[str, ...] = ("f0", "f1", "f2")) -> list[Column]:
    """The frames of a length and of the TAU lengths below it, repeated ones null."""
    own = [frame(F.greatest(length - d, F.lit(0))) for d in range(TAU + 1)]
    return [own[0].alias(names[0]), *[F.when(own[d] != own[d - 1], own[d]).alias(names[d]) for d in range(1, TAU + 1)]]


#: Characters that are counted to rule out candidates, 12 bits each.
_COUNTED = " aent"


def counts(line: Column) -> Column:
    """How often a line has each of some common characters, up to 4095, in one number."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(_COUNTED):
        n = F.char_length(line) - F.char_length(F.replace(line, F.lit(c), F.lit("")))
        out = out + F.shiftleft(F.least(n, F.lit(4095)).cast("long"), 12 * k)
    return out


def counts_allow(x: Column, y: Column, tau: int) -> Column:
    """An edit adds one to one character's count and takes one from another's at most."""
    apart = [F.abs(F.shiftright(x, 12 * k).bitwiseAND(F.lit(4095)) - F.shiftright(y, 12 * k).bitwiseAND(F.lit(4095))) for k in range(len(_COUNTED))]
    more = apart[0]
    for d in apart[1:]:
        more = more + d
    return more <= 2 * tau


def _let(values: list[Column], f) -> Column:
    """f of values that are worked out once each; an expression of its own, which no optimizer rule writes out."""
    names = [f"v{i}" for i in range(len(values))]
    packed = F.array(F.struct(*[v.alias(x) for v, x in zip(values, names)]))
    return F.get(F.transform(packed, lambda s: f(*[s[x] for x in names])), F.lit(0))


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def common_head(a: Column, i: Column, b: Column, j: Column, most: Column) -> Column:
    """How many code points a from ``i`` on and b from ``j`` on have in common, up to ``most``: a search by halves."""
    steps = F.transform(F.sequence(F.length(F.bin(F.greatest(most, F.lit(0)).cast("long"))), F.lit(0), F.lit(-1)), _power)
    return F.aggregate(steps, F.lit(0), lambda at, n: at + F.when((at + n <= most) & (F.substring(a, i + at + 1, n) == F.substring(b, j + at + 1, n)), n).otherwise(F.lit(0)))


def edit_distance_band(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of arrays of characters if at most ``tau``, else more than ``tau``; their sizes differ by ``tau`` at most.

    Bit k of column j stands for row j - tau + k, so the band moves down a row with every column: vertical
    differences are shifted by one. The distance is followed along the lower edge of the band until that meets
    the last row, then along that row.
    """
    width = 2 * tau + 1
    full, bottom = (1 << width) - 1, 1 << (2 * tau)
    m, n = F.size(a), F.size(b)
    state = F.struct(F.lit(((1 << (tau + 1)) - 1) << tau).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(tau).cast("int").alias("d"), F.lit(0).cast("long").alias("hp"), F.lit(0).cast("long").alias("hn"))

    def step(s: Column, j: Column) -> Column:
        c = F.get(b, j - 1)
        x = F.lit(0).cast("long")
        for k in range(width):
            row = j - tau + k  # from 1
            hit = (row >= 1) & (row <= m) & (F.get(a, F.greatest(row - 1, F.lit(0))) == c)
            x = x.bitwiseOR(F.when(hit, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))

        def first(x: Column) -> Column:
            d0 = ((x.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(F.lit(full).cast("long"))
            return _let([d0], second)

        def second(d0: Column) -> Column:
            hp = s["vn"].bitwiseOR(F.bitwise_not(d0.bitwiseOR(s["vp"]))).bitwiseAND(F.lit(full).cast("long"))
            return _let([d0, hp, d0.bitwiseAND(s["vp"])], third)

        def third(d0: Column, hp: Column, hn: Column) -> Column:
            down = F.shiftright(d0, 1)
            vp = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(F.lit(full).cast("long"))
            at = F.greatest(F.lit(0), m - j + tau)  # bit of the last row
            mark = _bit(at)
            on_edge = j + tau <= m
            edge = F.when(d0.bitwiseAND(F.lit(bottom).cast("long")) == 0, F.lit(1)).otherwise(F.lit(0))
            along = F.when(hp.bitwiseAND(mark) != 0, F.lit(1)).when(hn.bitwiseAND(mark) != 0, F.lit(-1)).otherwise(F.lit(0))
            return F.struct(vp.alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["d"] + F.when(on_edge, edge).otherwise(along)).alias("d"), hp.alias("hp"), hn.alias("hn"))

        return _let([x], first)

    # with fewer rows than the band's edge the last row is met at once: it stands m below the first
    state = F.struct(state["vp"].alias("vp"), state["vn"].alias("vn"), F.least(F.lit(tau), m).alias("d"), state["hp"].alias("hp"), state["hn"].alias("hn"))
    return F.when(n == 0, m).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), state, step, lambda s: s["d"]))


def reach(x: Column, hub: Column, tau: int = TAU) -> Column:
    """Struct (head, end): where the line first leaves the hub, and how far of the hub it follows with ``tau`` edits."""

    def on(s: Column, d: int, at: Column) -> Column:
        """Along diagonal d (place in x less place in the hub) from a place of the hub on; out of range stays null."""
        most = F.least(s["n"] - at, s["m"] - at - d)
        return F.when((at >= 0) & (at + d >= 0) & (most >= 0), at + common_head(s["h"], at, s["x"], at + d, most))

    def further(s: Column, last: dict[int, Column], k: int) -> Column:
        if k > tau:
            return F.struct(s["head"].alias("head"), F.greatest(*last.values(), F.lit(0)).alias("end")) if len(last) > 1 else F.struct(s["head"].alias("head"), s["head"].alias("end"))
        starts = {}
        for d in range(-k, k + 1):
            ways = [*([last[d] + 1] if d in last else []), *([last[d - 1]] if d - 1 in last else []), *([last[d + 1] + 1] if d + 1 in last else [])]
            best = F.greatest(*ways) if len(ways) > 1 else ways[0]
            starts[d] = F.least(best, s["n"], s["m"] - d)
        return _let([s, *[on(s, d, at) for d, at in starts.items()]], lambda s, *ends: further(s, dict(zip(starts, ends)), k + 1))

    def begun(x: Column, hub: Column, n: Column, m: Column) -> Column:
        head = common_head(hub, F.lit(0), x, F.lit(0), F.least(n, m))
        return _let([F.struct(x.alias("x"), hub.alias("h"), n.alias("n"), m.alias("m"), head.alias("head"))], lambda s: further(s, {0: s["head"]}, 1))

    return _let([x, hub, F.char_length(hub), F.char_length(x)], begun)


def within(a: Column, b: Column, tau: int = TAU) -> Column:
    """Whether two strings are at most ``tau`` edits apart."""
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    after = lambda x, n: F.substring(x, n + 1, F.char_length(x))
    head = lambda a, b: common_head(a, F.lit(0), b, F.lit(0), F.least(F.char_length(a), F.char_length(b)))

    def headless(a: Column, b: Column, n: Column) -> Column:
        return _let([F.reverse(after(a, n)), F.reverse(after(b, n))], lambda x, y: _let([x, y, head(x, y)], middle))

    def middle(a: Column, b: Column, n: Column) -> Column:
        return _let([chars(after(a, n)), chars(after(b, n))], lambda x, y: edit_distance_band(x, y, tau) <= tau)

    return (F.abs(F.char_length(a) - F.char_length(b)) <= tau) & _let([a, b, head(a, b)], headless)


_BLANK = " \t\r\x0b\x0c"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line, place) of lines that are not blank; ``place`` orders all lines."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos")
    return split.where(F.btrim("line", F.lit(_BLANK)) != "").withColumn("place", place.cast("decimal(38,0)"))


def _fitting(df: DataFrame, use: DataFrame | None = None) -> DataFrame:
    """A written table, or what is made of it, as the build side of a join: broadcast if its measured size allows it, else shuffled and hashed."""
    return (use or df).hint("broadcast" if df.count() <= BROADCAST_ROWS else "shuffle_hash")


def _marks(line: Column) -> list[Column]:
    """128 bits that tell lines apart."""
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit(7), line).alias("h2")]


def distinct_lines(docs: DataFrame, work: Workspace) -> DataFrame:
    """(id, line, place of the first, n): one row for each distinct line. The ids are fixed by writing them."""
    seen = _lines(docs).groupBy("line").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    return work.save(seen.select(F.monotonically_increasing_id().alias("id"), "line", "place", "n"), "lines")


#: What a line has in a group: ``code`` holds one bit for each way in which two rows may not meet; ``head`` to ``end`` and ``tail`` to ``off`` are
#: the places, from either side, where a near line may leave the group's hub.
_ROW = ("id", "code", "place", "length", "counts", "open", "head", "end", "tail", "off")


def near_lines(table: DataFrame, work: Workspace, tau: int = TAU, least: int = LEAST) -> DataFrame:
    """(id, earlier): lines of at least ``least`` code points that have an earlier one within ``tau`` edits, with that one's place.

    Every such line is found. Of several earlier neighbours the first that was met counts.
    """
    if tau > TAU:
        raise ValueError(f"the keys hold for up to {TAU} edits")
    own = table.where(F.char_length("line") >= least).select("id", "line", F.char_length("line").alias("length"))
    framed = own.select("id", "line", "length", *frames_of(F.col("length")))
    keys = framed.select("id", F.explode(segment_keys(F.col("line"), F.col("length"), [F.col("f0"), F.col("f1"), F.col("f2")])).alias("k")).select(F.col("k.key").alias("g"), F.col("k.kind").alias("code"), "id")
    # eight bytes of each key first: most stand alone
    shared = work.save(keys.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "shared")
    met = work.save(keys.join(_fitting(shared), "g"), "met")
    texts = work.save(table.join(_fitting(met.select("id"), met.select("id").distinct()), "id").select("id", "line", "place", F.char_length("line").alias("length"), counts(F.col("line")).alias("counts")), "texts")
    anywhere = [F.lit(x).alias(c) for c, x in zip(_ROW[-4:], (0, 1 << 30, 0, 1 << 30))]
    groups = met.join(texts.select("id", "place", "length", "counts"), "id").select("g", "id", "code", "place", "length", "counts", F.lit(True).alias("open"), *anywhere)
    groups, found = work.save(groups, "groups-0"), []
    for turn, (most, part) in enumerate(((SMALL, _by_cell), (LARGE, _by_segment), (None, None))):
        links, large = _met(groups, texts, work, turn, most, tau)
        found.append(links)
        if large is None or large.isEmpty():
            break
        closed = links.select("id").distinct().withColumn("closed", F.lit(True))
        still = large.join(closed, "id", "left").withColumn("open", F.col("open") & F.col("closed").isNull()).drop("closed")
        groups = work.save(part(still, texts), f"groups-{turn + 1}")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return work.save(out.groupBy("id").agg(F.min("earlier").alias("earlier")), "near")


def _met(groups: DataFrame, texts: DataFrame, work: Workspace, turn: int, most: int | None, tau: int) -> tuple[DataFrame, DataFrame | None]:
    """The links (id, earlier) within groups of up to ``most`` rows and of larger ones with their hubs; and the larger ones without those."""
    stats = groups.groupBy("g").agg(F.count("*").alias("n"), F.min(F.struct("place", "id", "length", "counts")).alias("hub"), F.max("open").alias("any")).where("n > 1 and any")
    marked = work.save(groups.join(stats.select("g", "n", "hub"), "g"), f"marked-{turn}")
    large = None if most is None else marked.where((F.col("n") > most) & (F.col("id") != F.col("hub.id")))
    pairs = _all_pairs(marked if most is None else marked.where(F.col("n") <= most), tau)
    if large is not None:
        x, y = ({c: F.col(f"hub.{c}") if hub else F.col(c) for c in ("place", "id", "length", "counts")} for hub in (True, False))
        pairs = pairs.union(large.where(F.col("open") & _alike(x, y, tau)).select(F.col("hub.id").alias("one"), F.col("id").alias("two")))
    pairs = work.save(pairs.distinct(), f"pairs-{turn}")
    one = texts.select(F.col("id").alias("one"), F.col("line").alias("line_1"), F.col("place").alias("earlier"))
    two = texts.select(F.col("id").alias("two"), F.col("line").alias("line_2"))
    good = pairs.join(one, "one").join(two, "two").where(within(F.col("line_1"), F.col("line_2"), tau))
    links = work.save(good.select(F.col("two").alias("id"), "earlier"), f"links-{turn}")
    work.drop(f"groups-{turn}")
    return links, large


def _alike(x: dict[str, Column], y: dict[str, Column], tau: int) -> Column:
    return (F.abs(x["length"] - y["length"]) <= tau) & counts_allow(x["counts"], y["counts"], tau)


def _all_pairs(rows: DataFrame, tau: int) -> DataFrame:
    """(earlier, later) of rows of one group that may be near, for later lines that are open."""
    one, two = (rows.select("g", *[F.col(c).alias(f"{s}_{c}") for c in _ROW]) for s in "xy")
    x, y = ({c: F.col(f"{s}_{c}") for c in _ROW} for s in "xy")
    # of two lines of one place (a repeated id) the one with the smaller id comes first
    before = (x["place"] < y["place"]) | ((x["place"] == y["place"]) & (x["id"] < y["id"]))
    same_places = (x["head"] <= y["end"]) & (y["head"] <= x["end"]) & (x["tail"] <= y["off"]) & (y["tail"] <= x["off"])
    may = y["open"] & (x["code"].bitwiseAND(y["code"]) == 0) & before & same_places & _alike(x, y, tau)
    return one.join(two, "g").where(may).select(F.col("x_id").alias("one"), F.col("y_id").alias("two"))


def _held(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows with their line and their hub's."""
    hubs = texts.select(F.col("id").alias("hub_id"), F.col("line").alias("hub"), F.col("length").alias("hub_length"))
    return rows.withColumn("hub_id", F.col("hub.id")).drop("hub", "n").join(texts.select("id", "line"), "id").join(hubs, "hub_id")


def _open_groups(rows: DataFrame) -> DataFrame:
    return rows.join(rows.groupBy("g").agg(F.max("open").alias("any")).where("any").select("g"), "g", "left_semi")


def _by_cell(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Groups by the cell of the hub's places in which a line leaves it; a line looks into the cells that it reaches with its edits too."""
    held = _held(_open_groups(rows), texts).withColumn("fore", reach(F.col("line"), F.col("hub"))).withColumn("back", reach(F.reverse("line"), F.reverse("hub")))
    placed = held.select("g", "id", "code", "place", "length", "counts", "open", "fore.head", "fore.end", F.col("back.head").alias("tail"), F.col("back.end").alias("off"), F.greatest(F.lit(4), F.ceil(F.col("hub_length") / CELLS)).cast("int").alias("wide"))
    own, to = F.floor(F.col("head") / F.col("wide")).cast("int"), F.floor(F.greatest("head", "end") / F.col("wide")).cast("int")
    cells = placed.withColumn("at", own).withColumn("cell", F.explode(F.sequence("at", to)))
    code = F.shiftleft("code", 1) + (F.col("cell") > F.col("at")).cast("int")
    return cells.select(F.xxhash64("g", "cell").alias("g"), "id", code.alias("code"), *_ROW[2:])


def _by_segment(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Groups by the segments of what is left of the lines when the heads and the tails that the whole group shares are cut off."""
    line, hub = F.col("line"), F.col("hub")
    shorter = F.least("length", "hub_length")
    held = _held(_open_groups(rows), texts).withColumn("same", common_head(line, F.lit(0), hub, F.lit(0), shorter))
    held = held.withColumn("last", common_head(F.reverse(line), F.lit(0), F.reverse(hub), F.lit(0), shorter - F.col("same")))
    cuts = held.groupBy("g").agg(F.min("same").alias("cut"), F.min("last").alias("less"))
    rest = held.join(cuts, "g").withColumn("size", F.col("length") - F.col("cut") - F.col("less")).withColumn("rest", F.expr("substring(line, cut + 1, size)"))
    keyed = rest.select("*", *frames_of(F.col("size"))).withColumn("k", F.explode(segment_keys(F.col("rest"), F.col("size"), [F.col("f0"), F.col("f1"), F.col("f2")])))
    return keyed.select(F.xxhash64("g", "k.key").alias("g"), "id", (F.shiftleft("code", 1) + F.col("k.kind")).alias("code"), *_ROW[2:])


def removed_lines(docs: DataFrame, work: Workspace, tau: int = TAU, least: int = LEAST) -> DataFrame:
    """(_id, _gone, _links, _firsts) of documents that lose lines: positions, how many of them are near another line, where the lines they repeat stand."""
    rows = docs.where("doc_id is not null")
    table = distinct_lines(rows, work)
    near = near_lines(table, work, tau, least)
    known = table.join(_fitting(near), "id", "left").where("n > 1 or earlier is not null").select(*_marks(F.col("line")), "place", "earlier")
    known = work.save(known, "known")
    for name in ("lines", "texts"):
        work.drop(name)
    own = _lines(rows).select("doc_id", "pos", F.col("place").alias("here"), *_marks(F.col("line")))
    gone = own.join(known, ["h", "h2"]).where("earlier is not null or here != place")
    first = F.floor(F.least("place", "earlier") / F.lit(1 << 31)).cast("long")
    told = gone.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("pos").alias("_gone"), F.count("earlier").alias("_links"), F.array_sort(F.collect_set(first)).alias("_firsts"))
    return work.save(told, "told")


def _kept(text: Column, gone: Column) -> Column:
    """The text less the lines at the given positions."""
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = _let([F.split(text, "\n")], lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n"))
    return F.when(gone.isNotNull(), kept).otherwise(text)


def line_dedup(docs: DataFrame, tau: int = TAU, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_links, first_docs, kept_text.

    A line (trimmed, at least ``least`` code points) is removed if a line within ``tau`` edits, or the same, stands
    earlier: in a document with a smaller id, or before it in its own. A shorter line that is not blank is removed if the
    same stands earlier. Lines are judged on the input. ``n_links`` counts the removed lines that have an earlier neighbour
    with another text, ``first_docs`` lists the documents of the earlier lines (of several neighbours one counts).
    Null texts stay null, empty ones as they are. A null id's lines are not compared. Rows of a repeated id are taken as
    repeats of each other's lines; those that have a line at its first place all keep it there.
    """
    told = removed_lines(docs, Workspace(docs.sparkSession, "lines"), tau, least)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(told.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    n_removed = F.coalesce(F.size("_gone"), F.lit(0)).cast("long")
    return rows.select("doc_id", n_lines.alias("n_lines"), n_removed.alias("n_removed"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_firsts", F.expr("cast(array() as array<bigint>)")).alias("first_docs"), _kept(F.col("text"), F.col("_gone")).alias("kept_text"))


def without_repeats(docs: DataFrame, tau: int = TAU, least: int = LEAST) -> DataFrame:
    """The documents, with all their columns, less removed lines; n_chars, where there is one, follows the text.

    Documents that had text and lose all of it go: each of their lines stands in an earlier document.
    """
    told = removed_lines(docs, Workspace(docs.sparkSession, "lines"), tau, least)
    text, kept = docs["text"], _kept(docs["text"], told["_gone"])
    rows = docs.join(told.hint("shuffle_hash"), docs["doc_id"].cast("long") == told["_id"], "left").where(text.isNull() | (F.trim(text) == "") | (F.trim(kept) != ""))
    columns = {"text": kept, "n_chars": F.char_length(kept).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return rows.select(*[columns[c].alias(c) if c in columns else docs[c] for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """``line_dedup`` with the digest of the kept text (null counts as empty)."""
    return line_dedup(docs).withColumn("kept_sha256", F.sha2(F.coalesce("kept_text", F.lit("")), 256)).drop("kept_text")
