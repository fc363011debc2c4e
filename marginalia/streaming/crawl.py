"""A crawl that can be stopped and taken up again: a queue with priorities, kept with what it has seen in one state.

A round takes the next addresses in line, looks at them, and changes queue, visited and pages at once. What an
executor has fetched is written before anything is made of it, so a lost one costs its own fetches only; a run
that stops between rounds, or in one, goes on from the last round that was complete."""

from __future__ import annotations

import time
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import little
from ..sources.state import State

#: Places in line are (round, ord, idx): the round that found the address, its page's place there, the link's place on it.
QUEUE = "url string, first boolean, round int, ord long, idx int, tries int"
VISITED = "url string, code int, tries int"
PAGES = "url string, body string"
#: What a look says of an address that there was no time for.
UNASKED = 0
#: Answers that settle an address, and those after which it is asked again at the end of the line.
SETTLED, AGAIN = (200, 404, 410), (403, 429)

#: Rows (url, tries, ...) to rows (url, code, body): code is missing where there was no answer, UNASKED where the
#: seconds given had passed.
Look = Callable[[DataFrame, float | None], DataFrame]


def start(state: State, seeds: DataFrame, prefer: str) -> None:
    """Queues the seeds (url, ord) if nothing has been queued yet."""
    if "queue" in state.tables():
        return
    once = seeds.groupBy("url").agg(F.min("ord").cast("long").alias("ord"))
    empty = lambda schema: state.spark.createDataFrame([], schema)
    queue = once.select("url", F.col("url").contains(prefer).alias("first"), F.lit(0).alias("round"), "ord", F.lit(0).alias("idx"), F.lit(0).alias("tries"))
    state.change(replace={"queue": queue, "visited": empty(VISITED), "pages": empty(PAGES)})


def step(state: State, number: int, look: Look, follow: Column, prefer: str, batch: int, seconds: float | None) -> int:
    """One round; the number of addresses that are left in line. `follow` is an array of addresses that the columns
    url and body of a page lead to."""
    queue, visited = state.read("queue", QUEUE), state.read("visited", VISITED)
    place = [F.col("first").desc(), F.col("round"), F.col("ord"), F.col("idx"), F.col("url")]
    taken = queue.orderBy(*place).limit(batch).withColumn("at", F.row_number().over(W.orderBy(*place)).cast("long") - 1)  # of a batch
    taken = F.broadcast(state.at(state.write(taken)))  # of a batch
    looked = state.at(state.write(look(taken, seconds)))
    seen = state.at(state.write(taken.join(looked.select("url", "code"), "url", "left")))
    settled = seen.filter(F.col("code").isin(*SETTLED))
    again = seen.filter(F.col("code").isNull() | F.col("code").isin(*AGAIN, UNASKED))
    later = F.col("code").isNull() | (F.col("code") != UNASKED)
    again = again.select(
        "url", "first", F.when(later, F.lit(number)).otherwise(F.col("round")).cast("int").alias("round"), F.when(later, F.col("at")).otherwise(F.col("ord")).cast("long").alias("ord"),
        F.when(later, F.lit(-1)).otherwise(F.col("idx")).cast("int").alias("idx"), F.when(later, F.col("tries") + 1).otherwise(F.col("tries")).cast("int").alias("tries"),
    )
    fetched = looked.filter("code = 200")
    paged = fetched.join(F.broadcast(taken.select("url", "at")), "url")  # bodies stay where they are
    found = paged.select("at", F.posexplode(follow).alias("idx", "target")).groupBy(F.col("target").alias("url")).agg(F.min(F.struct("at", "idx")).alias("p"), F.max("at").alias("last"))
    # an address of this round counts as queued until it was looked at; one whose answer dropped it may be found anew
    dropped = ~F.coalesce(F.col("code").isin(*SETTLED, *AGAIN, UNASKED), F.lit(True))
    known = seen.select("url", F.when(dropped, F.col("at")).alias("dropped_at"), F.lit(True).alias("was_taken"))
    found = found.join(known, "url", "left").filter("was_taken IS NULL OR last > dropped_at")
    rest = queue.join(F.broadcast(taken.select("url")), "url", "left_anti")
    found = little(found)
    # only what was found is looked for in the tables that grow, which are read where they lie
    old = visited.select("url").unionByName(rest.select("url")).join(found.select("url"), "url", "left_semi")
    fresh = found.join(little(old), "url", "left_anti")
    fresh = fresh.select("url", F.col("url").contains(prefer).alias("first"), F.lit(number).alias("round"), F.col("p.at").cast("long").alias("ord"), F.col("p.idx").cast("int").alias("idx"), F.lit(0).alias("tries"))
    line = state.write(rest.unionByName(again).unionByName(fresh))
    tries = (F.col("tries") + 1).cast("int").alias("tries")
    state.change(replace={"queue": line}, append={"visited": settled.select("url", F.col("code").cast("int").alias("code"), tries), "pages": fetched.select("url", "body")})
    return state.at(line).count()


def crawl(state: State, seeds: DataFrame, look: Look, follow: Column, prefer: str = "/book-reviews/", batch: int = 2000, deadline: float | None = None, clock: Callable[[], float] = time.monotonic, rounds: int | None = None) -> bool:
    """Crawls from the seeds (url, ord), or goes on with what an earlier run left. Addresses that hold `prefer`
    come first, each kind in the order found. Whether the line is empty: it may not be after `deadline` seconds or
    a number of rounds. Answers 200, 404 and 410 settle an address; 403, 429 and none send it to the end of the line;
    any other drops it until a later page leads to it again."""
    end = None if deadline is None else clock() + deadline
    start(state, seeds, prefer)
    first = state.read("queue", QUEUE).agg(F.max("round")).first()[0]
    if first is None:
        return True
    left = 1
    for number in count(first + 1):
        if rounds is not None and number > first + rounds or end is not None and clock() >= end:
            break
        left = step(state, number, look, follow, prefer, batch, None if end is None else end - clock())
        if not left:
            break
    return not left
