"""Matching names, concerts and events: joins on exact keys that never lose a pair.

Containment of one name in another is a substring join: the contained name's rarest gram must
occur in the container, so equality on that gram finds every pair without comparing all names.
Exact copies are collapsed before any pairing and re-attached as a star, so a group of copies
costs its size, not its square.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from backline.functions import text as X, vectors as V
from backline.functions.rounding import half_up
from backline.operators.normalize import concert_city, venue_key
from backline.session import cut_lineage, cut_packed


# gram sizes and the shortest text that uses each
_GRAMS = (6, 3, 2, 1)


def _sized(text: str, n: int) -> Column:
    return F.transform(X.grams(F.col(text), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))


def gram_sizes(texts: DataFrame, text: str) -> list[int]:
    """The gram sizes by which the texts are looked up, at most four."""
    size = F.coalesce(*[F.when(F.length(text) >= n, n) for n in _GRAMS])
    return [r.n for r in texts.select(size.alias("n")).where("n is not null").distinct().collect()]


def contained_pairs(small: DataFrame, big: DataFrame, block: list[str] | None = None, sizes: Sequence[int] = _GRAMS) -> DataFrame:
    """Pairs (a, b) with ``a``'s text inside ``b``'s, within equal ``block`` columns.

    ``small``: a, a_text; ``big``: b, b_text; both with the block columns.  Texts are non-empty.
    A text is looked up by its rarest gram of the largest size that fits it; all sizes go through
    one join, with the size as part of the key.  ``sizes`` may leave out sizes that no small text uses.
    """
    block, sizes = block or [], list(sizes) or _GRAMS
    size = F.length("a_text")
    own = F.coalesce(*[F.when(size >= n, _sized("a_text", n)) for n in _GRAMS])
    mine = small.select(*block, "a", "a_text", F.explode(own).alias("k"))
    pool = big.select(*block, "b", "b_text", F.explode(F.concat(*[_sized("b_text", n) for n in sizes])).alias("k"))
    key = [*block, "k"]
    pool = pool.join(mine.select(*key).distinct(), key, "left_semi")
    freq = pool.groupBy(*key).agg(F.count(F.lit(1)).alias("df"))
    rare = mine.join(freq, key, "left").groupBy(*block, "a", "a_text").agg(F.min_by("k", F.struct(F.coalesce("df", F.lit(0)), "k")).alias("k"))
    return rare.join(pool, key).where(F.contains("b_text", "a_text")).select(*block, "a", "b")


def contained_in_blocks(small: DataFrame, big: DataFrame, block: list[str]) -> DataFrame:
    """``contained_pairs`` for many blocks: texts of a block of few are compared as they are, those of a large one by grams."""
    few = 64
    size = big.groupBy(*block).agg(F.count(F.lit(1)).alias("size"))
    direct = small.join(big.join(size.where(F.col("size") <= few).drop("size"), block), block).where(F.contains("b_text", "a_text"))
    large = size.where(F.col("size") > few).drop("size")
    by_gram = contained_pairs(small.join(large, block, "left_semi"), big.join(large, block, "left_semi"), block)
    return direct.select(*block, "a", "b").unionByName(by_gram)


def match_artist(events: DataFrame, artists: DataFrame, name: str = "artist_name") -> DataFrame:
    """Each distinct event name with its artist: equal, or one name contains the other.

    Names are compared in comparable form without spaces, in which a spaced containment is a
    containment too.  Of several artists an equal one wins, then the longest name, then the id.
    """
    squash = lambda c: F.replace(X.event_name_key(c), F.lit(" "), F.lit(""))
    # both lists of distinct names are read several times below
    # the key is a generated row: a filter on it would otherwise go below the distinct and clean every event's name
    ev = cut_lineage(events.select(name).distinct().select(name, F.explode(F.array(squash(F.col(name)))).alias("key")).where("key <> ''"))
    art = cut_lineage(artists.select("artist_id", F.explode(F.array(squash(F.col("artist_name")))).alias("art_key")).where("art_key <> ''").groupBy("art_key").agg(F.min("artist_id").alias("artist_id")))
    keys = ev.select("key").distinct()
    a_in_e = contained_pairs(art.select(F.col("art_key").alias("a"), F.col("art_key").alias("a_text")), keys.select(F.col("key").alias("b"), F.col("key").alias("b_text")), sizes=gram_sizes(art, "art_key"))
    e_in_a = contained_pairs(keys.select(F.col("key").alias("a"), F.col("key").alias("a_text")), art.select(F.col("art_key").alias("b"), F.col("art_key").alias("b_text")), sizes=gram_sizes(ev, "key"))
    pairs = a_in_e.select(F.col("b").alias("key"), F.col("a").alias("art_key")).unionByName(e_in_a.select(F.col("a").alias("key"), F.col("b").alias("art_key")))
    best = pairs.join(art, "art_key").groupBy("key").agg(
        F.min_by("artist_id", F.struct((F.col("key") != F.col("art_key")).alias("o"), (-F.length("art_key")).alias("l"), "artist_id")).alias("artist_id")
    )
    return ev.join(best, "key").select(name, "artist_id")


def match_existing(events: DataFrame, concerts: DataFrame) -> DataFrame:
    """Events with the oldest stored concert that shares the source id, the url, or date and place.

    Three equality joins, each against one concert per key.  ``events`` carry event_key, artist_id,
    source_event_id, source_url, event_date, city, venue_name; ``concerts`` concert_id, created_at.
    """
    low = lambda c: F.lower(F.col(c))
    paths = [
        ([("artist_id", F.col("artist_id"), F.col("artist_id")), ("id", F.col("source_event_id"), F.col("source_event_id"))]),
        ([("artist_id", F.col("artist_id"), F.col("artist_id")), ("url", F.nullif("source_url", F.lit("")), F.nullif("source_url", F.lit("")))]),
        ([("artist_id", F.col("artist_id"), F.col("artist_id")), ("day", F.col("event_date"), F.col("concert_date")), ("city", low("city"), low("city")), ("venue", low("venue_name"), low("venue_name"))]),
    ]
    found = []
    for path in paths:
        names = [n for n, _, _ in path]
        oldest = concerts.select(*[c.alias(n) for n, _, c in path], F.struct("created_at", "concert_id").alias("o")).groupBy(*names).agg(F.min("o").alias("o"))
        keyed = events.select("event_key", *[e.alias(n) for n, e, _ in path])
        found.append(keyed.join(oldest, names).select("event_key", "o"))
    best = reduce(DataFrame.unionByName, found).groupBy("event_key").agg(F.min("o.concert_id").alias("x"), F.min("o").alias("o"))
    return events.join(best.select("event_key", F.col("o.concert_id").alias("existing_id")), "event_key", "left")


# --- connected groups ---------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """Smallest node id of each connected group: rows (node, root) for every node on an edge.

    Each round takes the least label among the neighbours and then the label's own label, so
    chains halve.  Labels go through packed files in the checkpoint folder and the loop ends when none changed.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_packed(both)
    labels = cut_packed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        step = cut_packed(step.join(jump, "next").select("node", "root", F.least("next", "far").alias("next")))
        moved = not step.where("next <> root").isEmpty()
        labels = step.select("node", F.col("next").alias("root"))
        if not moved:
            return labels


# --- duplicate concerts ---------------------------------------------------------------------


def _signatures(concerts: DataFrame) -> DataFrame:
    """Concerts with cleaned city and venue and the least id that shares all four fields."""
    s = concerts.where("concert_date is not null").select(
        "concert_id", "artist_id", "concert_date", F.lower(F.coalesce(concert_city(F.col("city")), F.lit(""))).alias("c"),
        F.lower(venue_key(F.col("venue_name"))).alias("v"),
    )
    return s


def _lead_word(v: Column) -> Column:
    return F.try_element_at(F.filter(F.split(v, " "), lambda w: F.length(w) > 3), F.lit(1))


def _edges(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _around(df: DataFrame, day: str = "d") -> DataFrame:
    """One row per day from the day before to the day after, as ``day``."""
    return df.withColumn("day", F.explode(F.array(F.date_add(day, -1), F.col(day), F.date_add(day, 1))))


def _with_neighbours(concerts: DataFrame) -> DataFrame:
    """The concerts that have another one of their artist at most a day away; no other can be a duplicate."""
    slim = cut_lineage(concerts.where("concert_date is not null").select("concert_id", "artist_id", "concert_date", "city", "venue_name"))
    days = slim.groupBy("artist_id", F.col("concert_date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    met = _around(days).groupBy("artist_id", F.col("day").alias("concert_date")).agg(F.sum("n").alias("n")).where("n > 1")
    return slim.join(met, ["artist_id", "concert_date"], "left_semi")


def duplicate_edges(concerts: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, whose connected groups are the concerts likely to be the same show.

    Two rows are linked when they share the artist, lie at most one day apart, have equal cities
    (or one empty, not both), and venues that are equal, contained in one another, share their
    leading word, or of which one is empty.  Where a whole class of rows is linked to a whole
    class (equal venue, equal leading word, empty venue), every member is tied to one member of
    the other class instead of to all, so edges grow with the rows and the groups stay the same.
    """
    rows = cut_lineage(_signatures(_with_neighbours(concerts)))  # read by every branch below
    sig = rows.groupBy("artist_id", F.col("concert_date").alias("d"), "c", "v").agg(F.min("concert_id").alias("id"))
    sig = cut_lineage(sig)
    known, open_ = sig.where("c <> ''"), sig.where("c = ''")
    out = []

    # classes of venues: the cleaned name, and the leading word
    def classes(df: DataFrame) -> DataFrame:
        marks = F.array_compact(F.array(F.concat(F.lit("v:"), F.col("v")), F.concat(F.lit("w:"), _lead_word(F.col("v")))))
        return df.where("v <> ''").withColumn("k", F.explode(marks))

    kc, oc = classes(known), classes(open_)
    heads = kc.groupBy("artist_id", "d", "c", "k").agg(F.min("id").alias("m"))
    out.append(_edges(kc.join(heads, ["artist_id", "d", "c", "k"]), "id", "m"))
    later = heads.select("artist_id", F.date_sub("d", 1).alias("d"), "c", "k", F.col("m").alias("m2"))
    out.append(_edges(heads.join(later, ["artist_id", "d", "c", "k"]), "m", "m2"))
    any_city = heads.groupBy("artist_id", F.col("d").alias("day"), "k").agg(F.min("m").alias("m2"))
    out.append(_edges(_around(oc).join(any_city, ["artist_id", "day", "k"]), "id", "m2"))
    no_city = oc.groupBy("artist_id", F.col("d").alias("day"), "k").agg(F.min("id").alias("m2"))
    out.append(_edges(_around(heads).join(no_city, ["artist_id", "day", "k"]), "m", "m2"))

    # an empty venue: one such row per artist, day and city
    blank_known, blank_open = known.where("v = ''"), open_.where("v = ''")
    same_city = known.select("artist_id", F.col("d").alias("day"), "c", F.col("id").alias("id2"))
    out.append(_edges(_around(blank_known).join(same_city, ["artist_id", "day", "c"]), "id", "id2"))
    out.append(_edges(_around(blank_open).join(same_city.drop("c"), ["artist_id", "day"]), "id", "id2"))
    one_open = open_.groupBy("artist_id", F.col("d").alias("day")).agg(F.min("id").alias("m2"))
    one_blank = blank_known.groupBy("artist_id", F.col("d").alias("day")).agg(F.min("id").alias("m2"))
    out.append(_edges(_around(blank_known).join(one_open, ["artist_id", "day"]), "id", "m2"))
    out.append(_edges(_around(open_).join(one_blank, ["artist_id", "day"]), "id", "m2"))

    # one venue inside the other
    def inside(small: DataFrame, big: DataFrame, block: list[str]) -> DataFrame:
        s = _around(small.where("v <> ''")).select(*block, F.col("id").alias("a"), F.col("v").alias("a_text"))
        g = big.where("v <> ''").withColumnRenamed("d", "day").select(*block, F.col("id").alias("b"), F.col("v").alias("b_text"))
        return _edges(contained_in_blocks(s, g, block), "a", "b")

    out += [inside(known, known, ["artist_id", "day", "c"]), inside(known, open_, ["artist_id", "day"]), inside(open_, known, ["artist_id", "day"])]
    pairs = cut_lineage(reduce(DataFrame.unionByName, out).distinct())

    # copies of one (artist, day, city, venue): a star on the least id, or on a neighbour when the city is unknown
    lead = sig.select("artist_id", F.col("d").alias("concert_date"), "c", "v", F.col("id").alias("lead"))
    copies = rows.join(lead, ["artist_id", "concert_date", "c", "v"]).where("concert_id <> lead")
    both = pairs.select(F.col("a").alias("lead"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("lead"), F.col("a").alias("other")))
    near = both.groupBy("lead").agg(F.min("other").alias("other"))
    star = _edges(copies.where("c <> ''"), "lead", "concert_id")
    hung = _edges(copies.where("c = ''").join(near, "lead"), "other", "concert_id")
    return pairs.unionByName(star).unionByName(hung).distinct()


def duplicate_groups(concerts: DataFrame) -> DataFrame:
    """Rows (concert_id, root) for every concert that has a duplicate; root is the least id."""
    return components(duplicate_edges(concerts)).select(F.col("node").alias("concert_id"), "root")


def completeness(df: DataFrame) -> Column:
    """How much a concert row tells: revenue, tickets, price, capacity, venue, city."""
    pos = lambda c, n: F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) > 0, n).otherwise(0)
    has = lambda c, n: F.when(F.coalesce(F.col(c), F.lit("")) != "", n).otherwise(0)
    return pos("total_revenue", 100) + pos("tickets_sold", 50) + pos("avg_ticket_price", 20) + pos("capacity", 10) + has("venue_name", 5) + has("city", 3)


def pick_winner(pairs: DataFrame, concerts: DataFrame) -> DataFrame:
    """For each edge the row to keep: the more complete one, the first on a tie."""
    s = concerts.select("concert_id", completeness(concerts).alias("s"))
    df = pairs.join(s.select(F.col("concert_id").alias("a"), F.col("s").alias("score_a")), "a").join(s.select(F.col("concert_id").alias("b"), F.col("s").alias("score_b")), "b")
    keep_a = F.col("score_a") >= F.col("score_b")
    return df.withColumn("winner", F.when(keep_a, F.col("a")).otherwise(F.col("b"))).withColumn("loser", F.when(keep_a, F.col("b")).otherwise(F.col("a")))


def _greedy_nodes(concerts: DataFrame) -> DataFrame:
    """One node per (artist, day, city, venue), with the keys it is found by and those it looks for.

    Two nodes match if one's ``shown`` keys meet the other's ``sought`` keys, or one venue lies inside the other: a city
    meets itself or no city; a venue meets itself, its leading word or no venue.
    """
    sig = _signatures(concerts).groupBy("artist_id", F.col("concert_date").alias("d"), "c", "v").agg(F.min("concert_id").alias("id"))
    city, venue, word = F.concat(F.lit("c:"), F.col("c")), F.concat(F.lit("v:"), F.col("v")), F.concat(F.lit("w:"), _lead_word(F.col("v")))
    has_city, has_venue = F.col("c") != "", F.col("v") != ""
    shown_city = F.when(has_city, F.array(city, F.lit("+"))).otherwise(F.array(F.lit("-")))
    sought_city = F.when(has_city, F.array(city, F.lit("-"))).otherwise(F.array(F.lit("+")))
    shown_venue = F.when(has_venue, F.array_compact(F.array(venue, word, F.lit("*")))).otherwise(F.array(F.lit("0")))
    sought_venue = F.when(has_venue, F.array_compact(F.array(venue, word, F.lit("0")))).otherwise(F.array(F.lit("*"), F.lit("0")))
    both = lambda x, y: F.flatten(F.transform(x, lambda i: F.transform(y, lambda j: F.struct(i.alias("city"), j.alias("venue")))))
    pos = F.struct("d", "id").alias("pos")
    return sig.select("id", "artist_id", "d", "c", "v", pos, both(shown_city, shown_venue).alias("shown"), both(sought_city, sought_venue).alias("sought"))


def _least_match(nodes: DataFrame, among: DataFrame, inside: DataFrame) -> DataFrame:
    """(id, least): for each of ``nodes`` the first position of a match in ``among``; a class of equals is one row."""
    key = ["artist_id", "day", "city", "venue"]
    shown = among.select("artist_id", F.col("d").alias("day"), "pos", F.explode("shown").alias("k")).groupBy("artist_id", "day", F.col("k.city").alias("city"), F.col("k.venue").alias("venue")).agg(F.min("pos").alias("pos"))
    sought = _around(nodes.select("id", "artist_id", "d", F.explode("sought").alias("k"))).select("id", "artist_id", "day", "k.city", "k.venue")
    by_class = sought.join(shown, key).select("id", "pos")
    by_text = inside.join(among.select(F.col("id").alias("other"), "pos"), "other").join(nodes.select("id"), "id", "left_semi").select("id", "pos")
    return by_class.unionByName(by_text).groupBy("id").agg(F.min("pos").alias("least"))


def greedy_duplicates(concerts: DataFrame) -> DataFrame:
    """Rows (concert_id, leader) of every concert that repeats an earlier one.

    In the order of (artist, day, id) a concert that matches an earlier leader is that leader's duplicate (the first one's,
    if it matches several), any other is a leader itself; duplicates never lead.  This is the outcome of comparing one
    concert after the other, found in rounds: a node that comes before all undecided nodes it matches leads, and
    the nodes that match it are decided.  A round costs a few rows per node, whatever the classes' sizes; the number of rounds
    is that of the longest chain of concerts a day apart.
    """
    nodes = cut_lineage(_greedy_nodes(concerts.where("concert_id is not null")))

    def texts(df: DataFrame, a: str, block: list[str]) -> DataFrame:
        return df.where("v <> ''").select(*block, F.col("id").alias(a), F.col("v").alias(f"{a}_text"))

    known, open_, near = nodes.where("c <> ''"), nodes.where("c = ''"), ["artist_id", "day"]
    out = []
    for small, big, block in ((known, known, [*near, "c"]), (known, open_, near), (open_, known, near)):
        found = contained_in_blocks(texts(_around(small), "a", block), texts(big.withColumn("day", F.col("d")), "b", block), block)
        out.append(_edges(found, "a", "b"))
    pairs = reduce(DataFrame.unionByName, out).distinct()
    inside = cut_lineage(pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"))))

    undecided, leaders = nodes, None
    while not undecided.isEmpty():
        least = _least_match(undecided, undecided, inside)
        marked = undecided.join(least, "id", "left")
        first = cut_lineage(marked.where("least is null or least >= pos").drop("least"))
        leaders = first if leaders is None else leaders.unionByName(first)
        matched = _least_match(undecided, first, inside).select("id")
        gone = matched.unionByName(first.select("id"))
        undecided = cut_lineage(undecided.join(gone, "id", "left_anti"))
    if leaders is None:
        return concerts.select("concert_id", F.col("concert_id").alias("leader")).where("false")
    leaders = cut_lineage(leaders)
    own = leaders.where("c <> ''").select("id", F.col("pos.id").alias("leader"))  # copies with a city follow the first
    rest = nodes.join(leaders.select("id"), "id", "left_anti")
    led = own.unionByName(_least_match(rest, leaders, inside).select("id", F.col("least.id").alias("leader")))
    heads = nodes.join(led, "id").select("artist_id", F.col("d").alias("concert_date"), "c", "v", "leader")
    rows = _signatures(concerts.where("concert_id is not null"))
    return rows.join(heads, ["artist_id", "concert_date", "c", "v"]).where("concert_id <> leader").select("concert_id", "leader")


def dedup_concerts(concerts: DataFrame, winner: str = "score", groups: str = "connected") -> DataFrame:
    """One concert per duplicate group; gaps of the kept row filled from the others in rank order.

    ``groups='connected'`` merges all that hangs together, ``'greedy'`` only what matches one leader (``greedy_duplicates``).
    ``winner='score'`` keeps the most complete row, ``'first'`` the earliest.  Each filled column
    is a conditional minimum over ranks, so no group is gathered in one place.  A row without an id
    joins no group; only rows without an id that are equal in every column become one.
    """
    known = concerts.where("concert_id is not null")
    roots = duplicate_groups(known) if groups == "connected" else greedy_duplicates(known).withColumnRenamed("leader", "root")
    df = concerts.join(roots, "concert_id", "left").withColumn("root", F.coalesce("root", F.col("concert_id")))
    df = df.withColumn("lone", F.when(F.col("concert_id").isNull(), F.sha2(F.to_json(F.struct(*concerts.columns)), 256)))
    rank = F.struct((-completeness(concerts)).alias("s"), "concert_date", "concert_id") if winner == "score" else F.struct("concert_date", "concert_id")
    df = df.withColumn("rank", rank)
    fill = {"venue_name": F.coalesce(F.col("venue_name"), F.lit("")) != "", **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0 for c in ("total_revenue", "tickets_sold", "capacity", "avg_ticket_price")}}
    row = F.struct(*concerts.columns)
    grouped = df.groupBy("root", "lone").agg(
        F.min_by(row, "rank").alias("r"), F.count(F.lit(1)).alias("merged"),
        *[F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("rank"))).alias(f"f_{c}") for c, ok in fill.items()],
    )
    return grouped.select(*[F.coalesce(F.col(f"f_{c}"), F.col(f"r.{c}")).alias(c) if c in fill else F.col(f"r.{c}").alias(c) for c in concerts.columns], "merged")


# --- duplicate events -----------------------------------------------------------------------


def event_text(of: Callable[[str], Column] = F.col) -> Column:
    parts = ["normalized_artist_name", "event_name", "normalized_venue_name", "normalized_city", "country"]
    return F.concat_ws(" ", *[F.nullif(of(c), F.lit("")) for c in parts], of("event_date").cast("string"))


def with_embedding(events: DataFrame) -> DataFrame:
    """Events with the token-hash vector of their text; one that is stored is kept."""
    if "embedding" in events.columns:
        return events
    vectors = V.hash_embed(events.select("event_id", event_text().alias("t")), "event_id", "t")
    return events.join(vectors, "event_id")


# what two events are compared by
COMPARED = ["event_id", "artist_name", "event_name", "venue_name", "city", "country", "event_date", "normalized_artist_name", "normalized_venue_name", "normalized_city"]
# weights of a duplicate score and the score that counts
_PARTS = {"semantic": 0.42, "artist": 0.22, "venue": 0.18, "city": 0.1, "day": 0.08}
_THRESHOLD = 0.86


def _least(part: str, lost: float = 0.0) -> float:
    """The least value of a part of the score for a duplicate that has lost ``lost`` on others."""
    return 1.0 - (1.0 - (_THRESHOLD - 5e-5) - lost) / _PARTS[part]


# an artist's word that at most so many events hold is rare: all events with it are compared
_FEW = 256
# frequencies of words are kept by slot, a byte each; words that share a slot count as the more frequent
_SLOTS = 1 << 13
_RARE = b"\0"
# length in days of the blocks in which events that share only frequent words meet
_BLOCK = 8
_SEP = "\x1f"
_CLOSE = 0.76  # overlap of close artists; any value in between loses nothing


def _cases() -> list[tuple[bool, float, float]]:
    """(the cities share a word, least overlap of artists, of venues) of the three ways to reach the threshold.

    What a pair loses on one part of the score is missing on the others: the cities share no word, and artist and venue are
    nearly equal; they share one and the artists are close; or they share one, the artists are not that close and the venues
    must be.
    """
    return [
        (False, _least("artist", _PARTS["city"]), _least("venue", _PARTS["city"])),
        (True, _CLOSE, _least("venue")),
        (True, _least("artist"), _least("venue", _PARTS["artist"] * (1.0 - _CLOSE))),
    ]


def _frequencies(names: DataFrame) -> list[tuple[bytes, list[int]]]:
    """Of each column: the order of magnitude of its words' frequency by slot, 0 for rare ones, and the lengths of the names."""
    row = lambda k, size, h: F.struct(F.lit(k).alias("k"), size.cast("int").alias("size"), h.cast("long").alias("h"))

    def marks(k: int, words: Column) -> Column:
        return F.array_append(F.transform(words, lambda t: row(k, F.lit(0), F.xxhash64(t))), row(k, F.size(words), F.lit(0)))

    words = names.dropna().select(F.explode(F.concat(*[marks(k, X.tokens(F.col(c))) for k, c in enumerate(names.columns)])).alias("m"))
    found = words.groupBy("m.k", "m.size", "m.h").agg(F.count(F.lit(1)).alias("n"))
    slot = F.when(F.col("size") == 0, F.pmod("h", F.lit(_SLOTS)))
    # a row a slot and a length at most
    rows = found.where((F.col("size") > 0) | (F.col("n") > _FEW)).groupBy("k", "size", slot.alias("slot")).agg(F.max("n").alias("n")).collect()
    out = []
    for k in range(len(names.columns)):
        classes = bytearray(_SLOTS)
        for r in rows:
            if r.k == k and r.slot is not None:
                classes[r.slot] = r.n.bit_length()
        out.append((bytes(classes), sorted(r.size for r in rows if r.k == k and r["size"] > 0)))
    return out


def _ranked(c: Column, classes: bytes) -> Column:
    """The words of a name with the order of magnitude of their frequency, the rarest first."""
    of = lambda t: F.substr(F.lit(classes), (F.pmod(F.xxhash64(t), F.lit(_SLOTS)) + 1).cast("int"), F.lit(1))
    return F.sort_array(F.transform(X.tokens(c), lambda t: F.struct(of(t).alias("k"), t.alias("t"))))


def _prefix(words: Column, sizes: list[int], t: float) -> Column:
    """The first words of a name of which one is among those of every name, of a length in ``sizes``, that it overlaps by ``t``.

    Overlap t of n and m words means t / (1 + t) * (n + m) common ones, so with k of them needed the n - k + 1 rarest
    words of one name meet those of the other.
    """
    n = F.size(words)

    def most(a: int) -> int:
        fits = [m for m in sizes if min(a, m) >= max(a, m) * t - 1e-9]
        return max((a - math.ceil((a + m) * (t / (1.0 + t)) - 1e-9) + 1 for m in fits), default=0)

    table = F.array(*[F.lit(most(a)) for a in range(1, 33)])
    return F.slice(words, F.lit(1), F.coalesce(F.try_element_at(table, n), (n - F.ceil(n * t - 1e-9) + 1).cast("int")))


def _meeting_keys(r: Column, day: Column, reach: int, artists: list[int], venues: list[int], rare: bool) -> Column:
    """Hashes of what an event is compared by: the rare words of the artist, or the frequent ones with a word of the city, one of
    the venue and a block of days, for each case."""
    cases = _cases()
    if rare:
        return F.transform(F.filter(_prefix(r.artist, artists, cases[-1][1]), lambda x: x.k == F.lit(_RARE)), lambda x: F.xxhash64(F.lit(0), x.t))
    blocks = F.array_distinct(F.array(F.floor((day - reach) / _BLOCK), F.floor((day + reach) / _BLOCK)))

    def crossed(i: int, frequent: Column, words: Column, places: Column) -> Column:
        within = lambda a, w: F.flatten(F.transform(places, lambda v: F.transform(blocks, lambda b: F.xxhash64(F.lit(i), a.t, w, v.t, b))))
        return F.flatten(F.transform(frequent, lambda a: F.flatten(F.transform(words, lambda w: within(a, w)))))

    keys = []
    for i, (same_city, artist, venue) in enumerate(cases, 1):
        frequent = F.filter(_prefix(r.artist, artists, artist), lambda x: x.k > F.lit(_RARE))
        keys.append(crossed(i, frequent, r.city if same_city else F.array(F.lit("")), _prefix(r.venue, venues, venue)))
    return F.concat(*keys)


def candidate_pairs(events: DataFrame, canon: DataFrame) -> DataFrame:
    """Pairs of (event_id, canon_id) that can reach the duplicate threshold, with the parts of their score that names and days
    make and, where no vectors are stored, their texts.

    Within two days; the canonical artist or venue contains the event's, or the city is equal; and equal vectors would
    reach the threshold.  In each of the three ways to do so (``_cases``) the artists share words, so a pair shares one of
    the rarest of both names.  Events that share a rare word are compared as they are; a frequent one is a key together with
    a word of the city, a rare one of the venue and a block of days.  A pair is kept under the first key that both have.

    An event moves once per key with all that is compared, so nothing is looked up by pair afterwards; a frame is compared
    with itself once for both directions.  The pairs of rare words are stored before those of frequent ones are looked for, so
    the rows of only one of the two lie on disk at a time.
    """
    own = events is canon
    texts = not all("embedding" in df.columns for df in (events, canon))
    plain = ["normalized_artist_name", "normalized_venue_name", "normalized_city", "event_date", *(["event_name", "country"] if texts else [])]
    names = events.select("artist_name", "venue_name")
    (artist_words, artists), (venue_words, venues) = _frequencies(names if own else names.unionByName(canon.select("artist_name", "venue_name")))

    def keyed(df: DataFrame, p: str, reach: int, rare: bool) -> DataFrame:
        df = df.where("event_id is not null and event_date is not null and artist_name is not null and venue_name is not null and city is not null")
        ranked = F.struct(_ranked(F.col("artist_name"), artist_words).alias("artist"), _ranked(F.col("venue_name"), venue_words).alias("venue"), X.tokens(F.col("city")).alias("city"))
        df = df.select("event_id", *plain, F.explode(F.array(ranked)).alias("r"))
        n_rare = F.size(F.filter("r.artist", lambda x: x.k == F.lit(_RARE)))
        words = F.concat_ws(_SEP, *[F.concat_ws(" ", c) for c in ("r.artist.t", "r.venue.t", "r.city")])
        keys = _meeting_keys(F.col("r"), F.unix_date("event_date"), reach, artists, venues, rare)
        return df.select(F.struct(F.col("event_id").alias("id"), words.alias("words"), n_rare.alias("rare"), *plain).alias(p), F.explode(keys).alias("h"))

    day = lambda p: F.unix_date(f"{p}.event_date")

    def first(n: str, cut: Callable[[Column], Column] = lambda x: x) -> Column:
        return F.try_element_at(F.array_intersect(cut(F.col(f"w.e_{n}")), cut(F.col(f"w.c_{n}"))), F.lit(1))

    cases, block = _cases(), F.floor(day("c") / _BLOCK)
    shared = first("artist", lambda x: _prefix(x, artists, cases[-1][1]))
    key = [
        F.xxhash64(F.lit(i), first("artist", lambda x, a=a: _prefix(x, artists, a)), first("city") if same_city else F.lit(""), first("venue", lambda x, v=v: _prefix(x, venues, v)), block)
        for i, (same_city, a, v) in enumerate(cases, 1)
    ]
    by_case = F.when(F.col("city") == 0, key[0]).when(F.col("artist") >= _CLOSE, key[1]).otherwise(key[2])

    def directed(a: str, b: str) -> Column:
        holds = lambda c: F.contains(f"{b}.{c}", f"{a}.{c}")
        near = holds("normalized_artist_name") | holds("normalized_venue_name") | (F.col(f"{b}.normalized_city") == F.col(f"{a}.normalized_city"))
        sides = [event_text(lambda c, p=p: F.col(f"{p}.{c}")).alias(n) for p, n in ((a, "e_text"), (b, "c_text"))] if texts else []
        return F.when(near, F.struct(F.col(f"{a}.id").alias("event_id"), F.col(f"{b}.id").alias("canon_id"), *sides))

    both = F.array_compact(F.array(directed("e", "c"), directed("c", "e")) if own else F.array(directed("e", "c")))

    def found(rare: bool) -> DataFrame:
        left, right = keyed(events, "e", 2, rare), keyed(canon, "c", 2 if own else 0, rare)
        # by size on disk the packed rows look small enough to broadcast, which their keys and texts are not
        met = left.join(right.hint("merge"), "h").where((F.abs(day("e") - day("c")) <= 2) & (F.col("e.id") < F.col("c.id") if own else F.col("e.id") != F.col("c.id")))
        # generated rows, so that what reads them does not work them out again
        lists = [F.split(F.col(f"{p}.words"), _SEP).alias(p) for p in "ec"]
        met = met.select("h", "e", "c", F.explode(F.array(F.struct(*lists))).alias("w"))
        part = lambda p, k: F.array_remove(F.split(F.col(f"w.{p}")[k], " "), "")
        met = met.select("h", "e", "c", F.explode(F.array(F.struct(*[part(p, k).alias(f"{p}_{n}") for p in "ec" for k, n in enumerate(_NAMES)]))).alias("w"))
        parts = [X.overlap(F.col(f"w.e_{n}"), F.col(f"w.c_{n}")).alias(n) for n in _NAMES] + [X.date_similarity(F.col("e.event_date"), F.col("c.event_date")).alias("day")]
        met = _within_reach(met.select("h", "e", "c", "w", F.explode(F.array(F.struct(*parts))).alias("p")).select("h", "e", "c", "w", "p.*"))
        # never null: a null check inferred for one side only would keep the sides from sharing one shuffle
        in_rare = F.coalesce(F.array_position("w.e_artist", shared) <= F.col("e.rare"), F.lit(False))
        met = met.where(in_rare & (F.col("h") == F.xxhash64(F.lit(0), shared)) if rare else ~in_rare & (F.col("h") == by_case))
        return met.select(F.explode(both).alias("s"), *_NAMES, "day").select("s.*", *_NAMES, "day")

    if not any(artist_words):
        return found(True)
    return cut_packed(found(True)).unionByName(found(False))


_NAMES = {"artist": "artist_name", "venue": "venue_name", "city": "city"}


def _within_reach(df: DataFrame, threshold: float = _THRESHOLD) -> DataFrame:
    """Pairs that reach the threshold if their vectors are equal."""
    known = reduce(Column.__add__, [F.col(part) * w for part, w in _PARTS.items() if part != "semantic"])
    return df.where(known >= threshold - 5e-5 - 1e-6 - _PARTS["semantic"])


def score_duplicates(pairs: DataFrame, events: DataFrame, canon: DataFrame, threshold: float = _THRESHOLD) -> DataFrame:
    """Similarity of candidate pairs and why; those at the threshold or above.

    Names and days are compared first, unless ``candidate_pairs`` has; only pairs that can still reach the threshold, were
    their vectors equal, compare them.  An ``embedding`` (sparse map) that ``events`` or ``canon`` carry is used; else the vectors are
    made of the texts where these meet.  Words and norms are made once an event.
    """
    df = pairs
    if not set(_NAMES) <= set(pairs.columns):
        side = lambda df, p, key: df.select(F.col("event_id").alias(key), *[X.tokens(F.col(c)).alias(f"{p}_{n}") for n, c in _NAMES.items()], F.col("event_date").alias(f"{p}_day"))
        df = pairs.join(side(events, "e", "event_id"), "event_id").join(side(canon, "c", "canon_id"), "canon_id")
        parts = [X.overlap(F.col(f"e_{n}"), F.col(f"c_{n}")).alias(n) for n in _NAMES] + [X.date_similarity(F.col("e_day"), F.col("c_day")).alias("day")]
        # a generated row per pair, so that the filter reads the parts instead of working them out again
        df = df.select("event_id", "canon_id", F.explode(F.array(F.struct(*parts))).alias("p")).select("event_id", "canon_id", "p.*")
    df = _within_reach(df, threshold)
    if any("embedding" in side.columns for side in (events, canon)) or "e_text" not in df.columns:
        vector = lambda df, p, key: df.select(F.col("event_id").alias(key), F.col("embedding").alias(f"{p}_vector"), V.sparse_norm(F.col("embedding")).alias(f"{p}_norm"))
        df = df.join(vector(with_embedding(events), "e", "event_id"), "event_id").join(vector(with_embedding(canon), "c", "canon_id"), "canon_id")
        semantic = V.sparse_cosine(F.col("e_vector"), F.col("c_vector"), F.col("e_norm"), F.col("c_norm"))
    else:
        semantic = V.text_cosine(F.col("e_text"), F.col("c_text"))
    df = df.select("event_id", "canon_id", *_NAMES, "day", F.explode(F.array(semantic)).alias("semantic"))
    score = half_up(reduce(Column.__add__, [F.col(part) * w for part, w in _PARTS.items()]), 4)
    df = df.withColumn("similarity", score).where(F.col("similarity") >= threshold)
    r3 = lambda c: half_up(F.col(c), 3).cast("string")
    reasons = F.array_compact(F.array(
        F.when(F.col("semantic") >= 0.82, F.concat(F.lit("semantic match "), r3("semantic"))),
        F.when(F.col("artist") >= 0.8, F.concat(F.lit("artist match "), r3("artist"))),
        F.when(F.col("venue") >= 0.8, F.concat(F.lit("venue match "), r3("venue"))),
        F.when(F.col("city") >= 0.9, F.lit("same city")), F.when(F.col("day") >= 0.9, F.lit("same or adjacent date")),
    ))
    return df.select("event_id", "canon_id", "similarity", "semantic", "artist", "venue", "city", "day", reasons.alias("reasons"))


def best_duplicate(scored: DataFrame) -> DataFrame:
    """Best canonical event per event: highest score, then the least id."""
    return scored.groupBy("event_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "canon_id", "reasons")).alias("b")).select(
        "event_id", F.col("b.canon_id").alias("canon_id"), (-F.col("b.s")).alias("similarity"), F.col("b.reasons").alias("reasons")
    )


def source_key(df: DataFrame) -> Column:
    nz = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.concat_ws("|", "source_platform", F.coalesce(nz("source_event_id"), nz("source_url"), F.col("canonical_key")))


def resolve_events(events: DataFrame, canon: DataFrame | None = None) -> DataFrame:
    """What becomes of each normalised event: updated, merged into another event, or created.

    Merged rows have the ``similarity`` to their best match and the ``match_reasons``.  First by equal canonical key, then by the best stored match, then among the new events
    themselves as connected groups under their least id, so row order does not matter.
    """
    events = cut_packed(events)
    vectors = any("embedding" in df.columns for df in (events, canon or events))
    needed = lambda df: [c for c in ("canonical_key", *COMPARED, "embedding") if c in df.columns]
    embedded = lambda df: with_embedding(df) if vectors else df
    first = F.rank().over(Window.partitionBy("canonical_key").orderBy("event_id"))
    heads = events.where("canonical_key is not null and event_id is not null").select(*needed(events), first.alias("place")).where("place = 1").drop("place")
    fresh = cut_packed(embedded(heads))
    known = None
    if canon is not None:
        canon = cut_packed(embedded(canon.where("event_id is not null").select(*needed(canon))))
        known = canon.groupBy("canonical_key").agg(F.min("event_id").alias("canon_id"))
        fresh = cut_packed(fresh.join(known, "canonical_key", "left_anti"))
        best = cut_packed(best_duplicate(score_duplicates(candidate_pairs(fresh, canon), fresh, canon)))
        rest = fresh.join(best, "event_id", "left_anti")
    else:
        best, rest = None, fresh
    own = cut_packed(score_duplicates(candidate_pairs(rest, rest), rest, rest).select("event_id", "canon_id", "similarity", "reasons"))
    matches = best_duplicate(own)
    matches = matches if best is None else matches.unionByName(best)
    roots = components(own.select(F.least("event_id", "canon_id").alias("a"), F.greatest("event_id", "canon_id").alias("b")).distinct())
    decided = rest.select("canonical_key", "event_id").join(roots.withColumnRenamed("node", "event_id"), "event_id", "left").select(
        "canonical_key", "event_id", F.coalesce("root", "event_id").alias("target"), F.when(F.col("root").isNull() | (F.col("root") == F.col("event_id")), "created").otherwise("merged").alias("decision"))
    if canon is not None:
        merged = fresh.select("canonical_key", "event_id").join(best, "event_id").select("canonical_key", "event_id", F.col("canon_id").alias("target"), F.lit("merged").alias("decision"))
        decided = decided.unionByName(merged)
    # one row per head: what its other listings become follows from it
    decided = decided.join(matches.select("event_id", "similarity", F.col("reasons").alias("match_reasons")), "event_id", "left").withColumnRenamed("event_id", "head")
    if canon is not None:
        decided = decided.unionByName(known.select("canonical_key", F.col("canon_id").alias("target"), F.lit("updated").alias("decision")), allowMissingColumns=True)
    merged = F.col("decision") == "merged"
    decided = decided.withColumns({"similarity": F.when(merged, F.col("similarity")), "match_reasons": F.when(merged, F.col("match_reasons"))})
    out = events.join(cut_packed(decided.select("canonical_key", "head", "target", "decision", "similarity", "match_reasons")), "canonical_key")
    action = F.when((F.col("event_id") != F.col("head")) & ~merged, "updated").otherwise(F.col("decision"))
    return out.withColumn("action", action).drop("head", "decision")


def source_references(resolved: DataFrame) -> DataFrame:
    """One row per source listing of a canonical event: the event it was resolved to and where it came from."""
    keyed = resolved.withColumn("source_key", source_key(resolved))
    rest = F.struct("source_platform", "source_event_id", "source_url", "canonical_key", "confidence_score")
    return keyed.groupBy("target", "source_key").agg(F.min(rest).alias("r")).select("target", "source_key", "r.*")


def duplicate_members(resolved: DataFrame) -> DataFrame:
    """Rows (group_id, event_id, role, similarity_score, reasons): the kept event and those merged into it.

    One row per event that stands for its canonical key; a group is named by its kept event.
    """
    heads = resolved.where("action = 'merged'").groupBy("target", "canonical_key").agg(F.min(F.struct("event_id", "similarity", "match_reasons")).alias("m"))
    merged = heads.select(F.col("target").alias("group_id"), F.col("m.event_id").alias("event_id"), F.lit("DUPLICATE").alias("role"), F.col("m.similarity").alias("similarity_score"), F.col("m.match_reasons").alias("reasons"))
    kept = merged.select("group_id").distinct().select(
        "group_id", F.col("group_id").alias("event_id"), F.lit("CANONICAL").alias("role"), F.lit(1.0).alias("similarity_score"), F.array(F.lit("existing canonical event")).alias("reasons"))
    return kept.unionByName(merged)


def merged_confidence(resolved: DataFrame, refs: DataFrame) -> DataFrame:
    """Confidence of each canonical event after merges: own plus 0.03 per reference, at most 0.15."""
    n = refs.groupBy("target").agg(F.count(F.lit(1)).alias("references"))
    top = resolved.where("action = 'merged'").groupBy("target").agg(F.max("confidence_score").alias("confidence"))
    boost = F.least(F.lit(0.15), F.col("references") * 0.03)
    return top.join(n, "target").select("target", "references", half_up(F.least(F.lit(1.0), F.col("confidence") + boost), 4).alias("confidence"))


# --- scraped concerts -------------------------------------------------------------------------


def validate_scraped(events: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """Confidence and reasons for a scraped concert against its expected artist.

    ``events``: source, event_date, artist_name, source_artist_name, venue_name, city, country,
    source_url, existing_id (from ``match_existing``).
    """
    name = X.artist_match(F.col("artist_name"), F.coalesce(F.nullif("source_artist_name", F.lit("")), F.col("artist_name")))
    df = events.withColumn("name_score", name)
    year = F.year("event_date")
    in_range = year.between(start_year, end_year)
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    placed = has("venue_name") & has("city") & has("country")
    good = F.col("name_score") >= 0.72
    conf = (
        F.when(F.col("source") == "SETLIST_FM", 0.45).otherwise(0.25) + F.when(in_range, 0.15).otherwise(0.0)
        + F.when(good, F.col("name_score") * 0.2).otherwise(0.0) + F.when(placed, 0.12).otherwise(0.0) + F.when(has("source_url"), 0.08).otherwise(0.0)
    )
    conf = F.when(F.col("existing_id").isNotNull(), F.least(F.lit(1.0), conf + 0.08)).otherwise(conf)
    reasons = F.array_compact(F.array(
        F.when(F.col("event_date").isNull(), F.lit("invalid event date")).when(~in_range, F.lit(f"outside requested year range {start_year}-{end_year}")),
        F.when(~good, F.concat(F.lit("weak artist match: "), F.coalesce("source_artist_name", F.lit("unknown source artist")))),
        F.when(~placed, F.lit("missing venue or location")),
    ))
    df = df.withColumn("confidence", half_up(conf, 2)).withColumn("reasons", reasons)
    return df.withColumn("valid", (F.size("reasons") == 0) & (F.col("confidence") >= 0.75))
