"""Key operators: dedupe by text, collisions, leaf and branch conflicts, unanimous namespaces."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .catalogs import first_by
from .graph import saved
from .planning import group_index


def dedupe_first(strings: DataFrame) -> DataFrame:
    """The first occurrence of each text, by seq [AGG11]. Map-side minima: a text of a third of all rows folds before the shuffle. Null texts are one text; of equal seq the row with the least other columns stays; no rows give none."""
    others = [c for c in strings.columns if c not in ("text", "seq")]
    best = strings.groupBy("text").agg(F.min(F.struct("seq", *others)).alias("_b"))
    return best.select("text", "_b.*").select(*strings.columns)


def active_entries(mapping: DataFrame, strings: DataFrame) -> DataFrame:
    """Entries whose text still occurs [FLT12]. Null texts match nothing; repeated entries stay repeated."""
    return mapping.join(strings.select("text").distinct(), "text", "left_semi")


def new_strings(strings: DataFrame, mapping: DataFrame) -> DataFrame:
    """First occurrences of texts that the map lacks [JN8, AGG11]; see dedupe_first. A null text is always new."""
    return dedupe_first(strings).join(mapping.select("text").distinct(), "text", "left_anti")


def supplement_map(mapping: DataFrame, strings: DataFrame) -> DataFrame:
    """Texts that the map lacks get the id of a T component, else of a t call; first by seq [JN9]. One union and one grouping by text: the map's entries come before all ids, so no anti-join is needed. Texts that the map repeats keep all their entries."""
    found = strings.where(F.col("type").isin("T-component", "t-call") & F.col("id").isNotNull() & (F.col("id") != ""))
    rank = F.struct((F.col("type") == "t-call").cast("int").alias("r"), F.col("seq").cast("long").alias("s"), F.col("id").alias("key"))
    best = found.groupBy("text").agg(F.min(rank).alias("_b"))
    both = best.select("text", "_b.key", F.lit(False).alias("_own")).unionByName(mapping.select("text", "key", F.lit(True).alias("_own")))
    gathered = both.groupBy("text").agg(F.collect_list(F.when(F.col("_own"), F.struct("key"))).alias("own"), F.min(F.when(~F.col("_own"), F.col("key"))).alias("other"))
    return gathered.select("text", F.explode(F.when(F.size("own") > 0, F.transform("own", lambda x: x["key"])).otherwise(F.array("other"))).alias("key"))


def bare_strings(strings: DataFrame) -> DataFrame:
    """Strings that nothing wraps yet: no t call, no T component with an id [FLT7]. Rows with a null type are left out."""
    return strings.where((F.col("type") != "t-call") & ~((F.col("type") == "T-component") & F.col("id").isNotNull()))


def family(key: Column) -> Column:
    """A key without the digits at its end. Suffixes of a key never leave its family."""
    return F.regexp_replace(key, "[0-9]+$", "")


def free_numbers(proposed: DataFrame, taken: DataFrame) -> DataFrame:
    """proposed (key, seq, ...) with n: the i-th proposal of a key, by seq, gets the i-th number from 1 on that the key's taken ones (key, n) leave free.

    The j-th taken number t has t - j free ones before it. So proposals at place i and taken numbers at place t - j merge in one order, proposals first where they tie, and a proposal's place in this order is its number. All places come from
    group_index, that is from range sorts, so neither a key with millions of proposals nor one with millions of taken numbers meets in one task, and all of it runs in the JVM. Keys of one proposal and nothing taken get 1 at once. `seq` must tie nothing within a key; rows with a null key get 1.
    """
    kept = [F.col(f"`{c}`") for c in proposed.columns]
    used = taken.select("key", "n").where("key IS NOT NULL").distinct()
    several = proposed.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    busy = saved(several.select("key", F.lit(False).alias("_taken")).union(used.select("key", F.lit(True))).groupBy("key").agg(F.max("_taken").alias("_taken")))
    out = proposed.join(busy.select("key"), "key", "left_anti").select(*kept, F.lit(1).cast("long").alias("n"))
    known = {r._taken for r in busy.select("_taken").distinct().collect()}
    if not known:
        return out
    mine = group_index(proposed.join(busy, "key").select(*kept, "_taken"), ["key"], ["seq"], "_i")
    out = out.unionByName(mine.where("NOT _taken").select(*kept, (F.col("_i") + 1).alias("n")))
    if known == {False}:
        return out
    numbers = group_index(used.join(mine.select("key").distinct(), "key", "left_semi"), ["key"], ["n"], "_j")
    places = mine.where("_taken").select("key", (F.col("_i") + 1).alias("_at"), F.lit(0).alias("_kind"), F.col("_i").alias("_tie"))
    gaps = numbers.select("key", (F.col("n") - F.col("_j") - 1).alias("_at"), F.lit(1).alias("_kind"), F.col("_j").alias("_tie"))
    merged = group_index(places.union(gaps), ["key"], ["_at", "_kind", "_tie"], "_p").where("_kind = 0").select(F.col("key").alias("_key"), F.col("_tie").alias("_i"), (F.col("_p") + 1).alias("n"))
    same = (F.col("m.key") == F.col("p._key")) & (F.col("m._i") == F.col("p._i"))
    return out.unionByName(mine.where("_taken").alias("m").join(merged.alias("p"), same).select(*[F.col(f"m.`{c}`") for c in proposed.columns], "p.n"))


def number_of(name: Column, key: Column) -> Column:
    """Which number a name has among key, key2, key3 ...: 1 for the key itself; null if it is none of them. Numbers of over 18 digits are never reached, and null too."""
    rest = F.substring(name, F.length(key) + 1, F.length(name))
    return F.when(name == key, F.lit(1).cast("long")).when(F.startswith(name, key) & rest.rlike("^([2-9]|[1-9][0-9]{1,17})$"), rest.try_cast("long"))


def numbered(key: Column, n: Column) -> Column:
    return F.when(n == 1, key).otherwise(F.concat(key, n.cast("string")))


def resolve_collisions(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """proposed (key, seq, ...) with final_key: the first free of k, k2, k3 ... in seq order, existing keys being taken [WIN10].

    Keys feed each other only if one is another with digits after it: k2 takes a name of k. All others, however many proposals and taken names they have, get free numbers by sorts in the JVM (free_numbers); if nothing is taken in a key's family
    those are its places. Keys that feed each other are settled as streams in seq order, one task for each shortest key of such a group. Rows with a null key get a null final_key.
    """
    columns = proposed.columns
    kept = [F.col(f"`{c}`") for c in columns]
    distinct = proposed.where("key IS NOT NULL").select("key").distinct()
    digits = F.length("key") - F.length(family(F.col("key")))
    shorter = F.transform(F.sequence(F.lit(1), digits), lambda i: F.substring("key", F.lit(1), F.length("key") - i))
    pairs = distinct.where(digits > 0).select(F.explode(shorter).alias("_root"), F.col("key").alias("_long")).join(distinct.withColumnRenamed("key", "_root"), "_root", "left_semi")
    roots = pairs.groupBy("_long").agg(F.min("_root").alias("_root"))  # a prefix sorts before what it begins, so the least is the shortest
    fed = saved(roots.union(roots.select(F.col("_root").alias("_long"), "_root").distinct()))
    marked = proposed.join(fed.withColumnRenamed("_long", "key"), "key", "left")
    names = existing.select(F.col("key").alias("_name")).where("_name IS NOT NULL").distinct().withColumn("_f", family(F.col("_name")))
    alone = marked.where("_root IS NULL").select(*kept)
    owners = distinct.join(fed.select(F.col("_long").alias("key")), "key", "left_anti").withColumn("_f", family(F.col("key")))
    taken = names.join(owners, "_f").select("key", number_of(F.col("_name"), F.col("key")).alias("n")).where("n IS NOT NULL")
    free = free_numbers(alone, taken)
    settled = free.select(*kept, F.when(F.col("key").isNotNull(), numbered(F.col("key"), F.col("n"))).alias("final_key"))
    schema = T.struct_of([(f.name, f.dataType) for f in proposed.schema.fields], "final_key string")

    def settle(key: tuple, table: pa.Table, old: pa.Table) -> pa.Table:
        used, last = set(old["_name"].to_pylist()), {}
        table = table.sort_by("seq")
        final = []
        for k in table["key"].to_pylist():
            n, name = last.get(k, 1), k
            if name in used:
                n = max(n, 2)
                while f"{k}{n}" in used:
                    n += 1
                name = f"{k}{n}"
                last[k] = n  # smaller suffixes of k are all taken
            used.add(name)
            final.append(name)
        return table.select(columns).append_column("final_key", pa.array(final, pa.string()))

    left = marked.where("_root IS NOT NULL")
    tops = fed.select("_root").distinct().withColumn("_f", family(F.col("_root")))
    right = names.join(tops, "_f").where(F.startswith("_name", F.col("_root"))).select(F.col("_root").alias("_of"), "_name")
    return settled.unionByName(left.select(*kept, "_root").groupBy("_root").cogroup(right.groupBy("_of")).applyInArrow(settle, schema))


def ancestors(key: str = "key") -> F.Column:
    """All proper dotted prefixes of a key."""
    parts = F.split(key, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def leaf_branch_conflicts(keys: DataFrame) -> DataFrame:
    """Keys that are also a branch of another key [JN11]: ancestors are exploded, so the prefix join is an equi semi join. Null keys are left out, repeated ones come once."""
    branches = keys.where(F.instr("key", ".") > 0).select(F.explode(ancestors()).alias("key")).distinct()
    return keys.select("key").distinct().join(branches, "key", "left_semi")


def rename_conflicts(mapping: DataFrame) -> DataFrame:
    """mapping (text, key, seq) with final_key: leaves that are branches too become key + 'Label', then with the first free number from 2 on, in seq order [WIN11].

    A conflict takes names of its own only: its key + 'Label' and digits. Where none of these names is a conflict itself, it gets free numbers by sorts in the JVM (free_numbers); so does a key of millions of texts. A conflict that frees
    such a name, by leaving it, makes order matter: those few families are settled as streams in seq order.
    """
    columns = mapping.columns
    kept = [F.col(f"`{c}`") for c in columns]
    hits = leaf_branch_conflicts(mapping).withColumn("_hit", F.lit(True))
    marked = mapping.join(hits, "key", "left")
    label = F.concat("key", F.lit("Label"))
    asked = marked.where("_hit").withColumn("_f", label)
    names = marked.where("_hit IS NULL").select("key", F.lit(None).cast("long").alias("_at")).distinct().union(marked.where("_hit").select("key", F.col("seq").cast("long")))
    names = names.select(F.col("key").alias("_key"), "_at", family(F.col("key")).alias("_f")).join(asked.select("_f").distinct(), "_f", "left_semi")
    freed = names.where("_at IS NOT NULL").select("_f").distinct()
    schema = T.struct_of([(f.name, f.dataType) for f in mapping.schema.fields], "final_key string")

    def settle(key: tuple, table: pa.Table, others: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        used = set(others["_key"].to_pylist())
        freed = sorted((at, k) for k, at in zip(others["_key"].to_pylist(), others["_at"].to_pylist(), strict=True) if at is not None)
        final, i, least = [], 0, 2
        for k, seq in zip(table["key"].to_pylist(), table["seq"].to_pylist(), strict=True):
            while i < len(freed) and freed[i][0] < seq:
                used.discard(freed[i][1])
                i, least = i + 1, 2
            name = f"{k}Label"
            if name in used:
                while f"{k}Label{least}" in used:
                    least += 1
                name = f"{k}Label{least}"
            used.add(name)
            final.append(name)
        return table.select(columns).append_column("final_key", pa.array(final, pa.string()))

    plain = asked.join(freed, "_f", "left_anti")
    taken = names.where("_at IS NULL").join(plain.select("_f").distinct(), "_f", "left_semi")
    numbers = taken.select(F.col("_f").alias("key"), number_of(F.col("_key"), F.col("_f")).alias("n")).where("n IS NOT NULL")
    # the rows under their new key; the old one beside it
    renamed = free_numbers(plain.select(*[F.col(f"`{c}`") if c != "key" else F.col("_f").alias("key") for c in columns], F.col("key").alias("_old")), numbers)
    free = renamed.select(*[F.col(f"`{c}`") if c != "key" else F.col("_old").alias("key") for c in columns], numbered(F.col("key"), F.col("n")).alias("final_key"))
    touched = asked.join(freed, "_f", "left_semi").groupBy("_f").cogroup(names.join(freed, "_f", "left_semi").groupBy("_f")).applyInArrow(settle, schema)
    return free.unionByName(touched).unionByName(marked.where("_hit IS NULL").select(*kept, F.col("key").alias("final_key")))


def unanimous_namespace(keys: DataFrame, *by: str) -> DataFrame:
    """by, ns: the namespace that all keys share, null if any has none or two differ [AGG13]. A null key has none; repeated keys and other columns make no difference."""
    ns = T.namespace("key")
    same = (F.count("*") == F.count(ns)) & (F.min(ns) == F.max(ns))
    return keys.groupBy(*by).agg(F.when(same, F.min(ns)).alias("ns"))


def component_keys(sites: DataFrame) -> DataFrame:
    """component, keys: the distinct keys that each component uses, in order [AGG16]. A component's keys are one value by nature."""
    return sites.groupBy("component").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def alphabetical(c: Column | str) -> Column:
    """A name as people sort it: letters before their accents, accents before their case, by Unicode's rules (ICU's root order)."""
    return F.collate(T.lit_any(c), "UNICODE")


def keygen_order(strings: DataFrame) -> DataFrame:
    """strings with rank in each file: by component in alphabetical order (none first), then seq; (file in alphabetical order, rank) is the batch order [WIN6]. A file's strings are sorted with spilling; rows of one seq and component tie."""
    return strings.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(alphabetical(F.coalesce("component", F.lit(""))), "seq")))


def replacement_sites(strings: DataFrame, mapping: DataFrame) -> DataFrame:
    """Occurrences whose text has a key [JN10]; by sorting, as a map can be far larger than its files. Null texts match nothing; of a text that the map repeats the greatest key counts; repeated occurrences stay."""
    return strings.join(first_by(mapping.select("text", "key"), ["text"], F.desc("key")).hint("merge"), "text")


def client_namespaces(sites: DataFrame, clients: DataFrame) -> DataFrame:
    """namespace, files: which namespaces the files that reach the browser use, and how many of these files use each [AGG14]. sites: file and key of each use (replacement_sites); clients: path (graph.client_files). Keys without a namespace, null files and repeated rows add nothing."""
    used = sites.select("file", T.namespace("key").alias("namespace")).where("namespace IS NOT NULL").distinct()
    return used.join(clients.select(F.col("path").alias("file")).distinct().hint("merge"), "file", "left_semi").groupBy("namespace").agg(F.count("*").alias("files"))


def map_head(mapping: DataFrame, n: int = 30) -> DataFrame:
    """The first n entries of a map (text, key, seq), which a prompt shows [WIN8]: each task keeps n rows, no sort of the map is made. Entries of equal seq are taken by text."""
    return mapping.orderBy("seq", "text").limit(n)
