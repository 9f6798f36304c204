"""Rooted trees in Newick text as tables of nodes, and their clades over many trees.

The grammar is read once from left to right: nested brackets, quoted names with doubled quotes, comments in square
brackets, lengths, names of inner nodes, and a bare name as a tree of one leaf. A clade is known by the sum of
its leaves' hashes, so that trees are compared by an equi-join or a count and no list of leaves is built on the way.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s+|\[[^\]]*\]|(?P<mark>[(),:;])|'(?P<quoted>(?:[^']|'')*)'|(?P<name>[^\s()\[\]',:;]+)")
NODES = "array<struct<node: int, parent: int, name: string, length: double, leaves: int, clade: long>>"


def parse(text: str | None) -> list[tuple[int, int | None, str | None, float | None, int, int]]:
    """(node, parent, name, length, leaves below, clade) from the root, node 0, on; a text that is no tree is an error, a null or blank one has no nodes."""
    if text is None or not text.strip():
        return []
    parent, name, length, kids = [None], [None], [None], [0]
    at, pos, want_length, ended, fresh = 0, 0, False, False, True
    while pos < len(text):
        m = TOKEN.match(text, pos)
        if m is None or ended and (m["mark"] or m["quoted"] is not None or m["name"]):
            raise ValueError(f"no tree from character {pos} on")
        pos, mark = m.end(), m["mark"]
        word = m["quoted"].replace("''", "'") if m["quoted"] is not None else m["name"]
        if word is not None:
            if want_length:
                length[at], want_length = float(word), False
            elif name[at] is None and length[at] is None:
                name[at] = word
            else:
                raise ValueError(f"two names at character {pos}")
            fresh = False
        elif mark is None:
            continue
        elif want_length:
            raise ValueError(f"no length at character {pos}")
        elif mark == "(" and not fresh:
            raise ValueError(f"a bracket after a name at character {pos}")
        elif mark == "(" or mark == "," and parent[at] is not None:
            up = at if mark == "(" else parent[at]
            parent.append(up)
            name.append(None)
            length.append(None)
            kids.append(0)
            kids[up] += 1
            at, fresh = len(parent) - 1, True
        elif mark == ")" and parent[at] is not None:
            at, fresh = parent[at], False
        elif mark == ":":
            want_length, fresh = True, False
        elif mark == ";" and at == 0:
            ended = True
        else:
            raise ValueError(f"{mark} at character {pos}")
    if at or want_length:
        raise ValueError("the text ends within the tree")
    leaves, clade = [0] * len(parent), [0] * len(parent)
    for k in range(len(parent) - 1, -1, -1):
        if not kids[k]:
            leaves[k], clade[k] = 1, xxhash.xxh3_64_intdigest((name[k] or "").encode())
        if k:
            leaves[parent[k]] += leaves[k]
            clade[parent[k]] += clade[k]
    signed = lambda x: (x + 2**63) % 2**64 - 2**63
    return [(k, parent[k], name[k], length[k], leaves[k], signed(clade[k])) for k in range(len(parent))]


def nodes(text: Column) -> Column:
    """The nodes of a tree as an array of (node, parent, name, length, leaves, clade)."""

    @F.pandas_udf(NODES)
    def read(texts: pd.Series) -> pd.Series:
        fields = ("node", "parent", "name", "length", "leaves", "clade")
        return texts.map(lambda t: [dict(zip(fields, n, strict=True)) for n in parse(t)])

    return read(text)


def node_table(trees: DataFrame, text: str, *key: str) -> DataFrame:
    """(key, node, parent, name, length, leaves, clade): a row a node of each tree."""
    return trees.select(*key, F.explode(nodes(F.col(text))).alias("n")).select(*key, "n.*")


def leaves(text: Column) -> Column:
    """The sorted leaf names of a tree; leaves without a name are empty names."""

    @F.pandas_udf("array<string>")
    def read(texts: pd.Series) -> pd.Series:
        def own(t: str | None) -> list[str]:
            found = parse(t)
            inner = {n[1] for n in found}
            return sorted(n[2] or "" for n in found if n[0] not in inner)

        return texts.map(own)

    return read(text)


def clade_support(trees: DataFrame, text: str, key: str) -> DataFrame:
    """(clade, leaves, n, share): in how many of the trees (one a ``key``) a clade of two leaves or more stands below the root."""
    rows = node_table(trees, text, key).where("parent is not null and leaves > 1").select(key, "clade", "leaves").distinct()
    total = trees.agg(F.countDistinct(key).alias("__n"))  # one row
    out = rows.groupBy("clade", "leaves").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    return out.select("clade", "leaves", "n", (F.col("n").cast("double") / F.col("__n")).alias("share"))


def clade_of(names: Column) -> Column:
    """The key of the clade of these leaf names."""

    @F.pandas_udf("long")
    def key(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: (sum(xxhash.xxh3_64_intdigest(n.encode()) for n in x) + 2**63) % 2**64 - 2**63)

    return key(names)
