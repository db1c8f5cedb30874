"""People and nodes: contacts into a registry in their order, merges of nodes with all that hangs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import kept
from .chains import ends, places


def synced(contacts: DataFrame, aliases: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What reading contacts one by one leaves: ((contact, person, added), (type, value, person)).

    contacts (contact, name, phones, emails) are read in the order of ``contact``. Each goes to the person who has its
    first known phone, else email, else name, in the registry's ``aliases`` (type, value, person) or from a contact before
    it; else a new person is added. All its aliases that nobody has go to that person, so later contacts find them.
    Contacts without phone and mail are left out.

    An alias belongs to the registry or to the first contact that carries it, so a contact points to that contact if it
    came before; the chains of these pointers end at a registered or a new person. A new person's id is a digest of the
    name, or of name and contact where ``people`` (person) has that id already.
    """
    read = contacts.where((F.size(F.coalesce("phones", F.array())) > 0) | (F.size(F.coalesce("emails", F.array())) > 0))
    listed = lambda kind, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    every = F.concat(listed("phone", F.col("phones")), listed("email", F.col("emails")), listed("name", F.array("name")))
    carried = kept(read.select("contact", "name", F.posexplode(every).alias("nth", "a")).select("contact", "name", "nth", "a.type", "a.value").where("value is not null"), "carried")
    known = aliases.groupBy("type", "value").agg(F.min("person").alias("person"))
    first = carried.groupBy("type", "value").agg(F.min("contact").alias("first"))
    owned = carried.join(first, ["type", "value"]).join(known, ["type", "value"], "left")
    there = owned.where("person is not null or first < contact")
    found = there.groupBy("contact").agg(F.min_by(F.struct("person", F.when(F.col("person").isNull(), F.col("first")).alias("before")), "nth").alias("m")).select("contact", "m.*")
    rows = kept(read.select("contact", "name").join(found, "contact", "left"), "found")
    chained = ends(rows.where("before is not null").select(F.col("contact").alias("node"), F.col("before").alias("parent"))).select(F.col("node").alias("contact"), "end")
    ended = rows.join(chained, "contact", "left").select("contact", "name", F.coalesce("end", "contact").alias("end"))
    digest = lambda c: F.substring(F.sha2(c, 256), 1, 12)
    taken = people.select(F.col("person").alias("_id"), F.lit(True).alias("_taken")).distinct()
    heads = rows.where("before is null").withColumn("_id", digest(F.col("name"))).join(taken, "_id", "left")
    new = F.when(F.col("_taken"), digest(F.concat("name", F.lit("#"), F.col("contact").cast("string")))).otherwise(F.col("_id"))
    heads = heads.select(F.col("contact").alias("end"), F.coalesce("person", new).alias("person"), F.col("person").isNull().alias("_new"))
    who = kept(ended.join(heads, "end").select("contact", "person", (F.col("_new") & (F.col("end") == F.col("contact"))).alias("added")), "synced")
    fresh = first.join(known.drop("person"), ["type", "value"], "left_anti").join(who.select(F.col("contact").alias("first"), "person"), "first")
    return who, fresh.select("type", "value", "person")


def merged(nodes: DataFrame, edges: DataFrame, merges: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after merges (dupe, survivor, nth): ``folded`` and ``moved``."""
    pointers = pointed(nodes, merges)
    chain = kept(ends(pointers), "ends")
    return folded(nodes, merges, pointers, chain), moved(edges, chain, at)


def pointed(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """(node, parent, step): merges (dupe, survivor, nth) as pointers, and those of before in the nodes' ``merged_into``.

    So chains are followed to their end, and A into B into C in one run or in two is the same.
    """
    old = nodes.where("merged_into is not null").select(F.col("node").alias("dupe"), F.col("merged_into").alias("survivor"), F.lit(-1).cast("long").alias("nth"))
    now = merges.select("dupe", "survivor", F.col("nth").cast("long").alias("nth"))
    return kept(now.union(old).groupBy("dupe").agg(F.max_by(F.struct("survivor", "nth"), "nth").alias("m")).select(F.col("dupe").alias("node"), F.col("m.survivor").alias("parent"), F.struct("m.nth", "dupe").alias("step")), "pointers")


def folded(nodes: DataFrame, merges: DataFrame, pointers: DataFrame, chain: DataFrame) -> DataFrame:
    """nodes (node, summary, merged_into) after merges, by their pointers and the ends (node, end) of these.

    Summaries of merged nodes go behind the survivor's in the order of the chains, empty ones left out; merged nodes keep theirs and
    point to whom they were merged into.
    """
    fold = merges.select(F.col("dupe").alias("node")).distinct()  # summaries merged before are in their survivors' already
    said = chain.join(fold, "node").join(nodes.where("summary <> ''").select("node", "summary"), "node").join(places(pointers), "node")
    texts = said.groupBy("end").agg(F.sort_array(F.collect_list(F.struct("place", "summary"))).alias("more"))  # one node's own texts
    below = F.array_join(F.transform("more", lambda m: m["summary"]), "\n")
    whole = F.when(F.col("more").isNull(), F.col("summary")).when(F.coalesce("summary", F.lit("")) == "", below).otherwise(F.concat_ws("\n", "summary", below))
    into = merges.groupBy("dupe").agg(F.max_by("survivor", F.col("nth").cast("long")).alias("_into")).withColumnRenamed("dupe", "node")
    return nodes.join(texts.withColumnRenamed("end", "node"), "node", "left").join(into, "node", "left").select("node", whole.alias("summary"), F.coalesce("_into", "merged_into").alias("merged_into"))


def moved(edges: DataFrame, chain: DataFrame, at: Column) -> DataFrame:
    """edges (edge, src, dst, type, invalid_at, reason, copied_from) after merges, by the ends (node, end) of their chains.

    A fact of a merged node, in either direction, is copied between the ends of both its nodes' chains and stamped, unless it is
    stamped already; one between nodes with one end stays as it is.
    """
    to = lambda c, name: chain.select(F.col("node").alias(c), F.col("end").alias(name))
    rows = edges.join(to("src", "_s"), "src", "left").join(to("dst", "_d"), "dst", "left")
    rows = rows.withColumns({"_a": F.coalesce("_s", "src"), "_b": F.coalesce("_d", "dst")})
    leaves = (F.col("_s").isNotNull() | F.col("_d").isNotNull()) & F.col("invalid_at").isNull() & (F.col("_a") != F.col("_b"))
    rows = kept(rows.withColumn("_moved", leaves), "moved")
    into = F.when(F.col("_s").isNotNull(), F.col("_s")).otherwise(F.col("_d")).cast("string")
    stayed = rows.select("edge", "src", "dst", "type", F.when(F.col("_moved"), at).otherwise(F.col("invalid_at")).alias("invalid_at"), F.when(F.col("_moved"), F.concat(F.lit("merged into "), into)).otherwise(F.col("reason")).alias("reason"), "copied_from")
    copies = rows.where("_moved").select(F.concat("edge", F.lit("+")).alias("edge"), F.col("_a").alias("src"), F.col("_b").alias("dst"), "type", "invalid_at", "reason", F.col("edge").alias("copied_from"))
    return stayed.union(copies)
