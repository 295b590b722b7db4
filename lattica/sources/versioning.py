"""Versioned collections: snapshots, branches, diff and three-way merge as joins.

A repository is a folder: every commit of a collection is a Parquet snapshot that
is never changed, and the log is a small JSON file that is replaced whole (one
writer at a time). Diffs and merges are full outer joins on ``_id``.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

#: How a merge treats rows that both sides changed: by field, by row, or one side wins.
MODES = ("field", "row", "ours", "theirs")


class VersionError(ValueError):
    """An unknown revision or a merge that cannot be done."""


def _fields(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "_id"]


def _doc(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """(_id, name: struct of the columns), null-filled to the given columns."""
    have = set(df.columns)
    cols = [(F.col(f"`{c}`") if c in have else F.lit(None)).alias(c) for c in (columns or _fields(df))]
    return df.select("_id", F.struct(*cols).alias(name) if cols else F.struct(F.lit(1).alias("_")).alias(name))


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Dotted paths of the scalar (and array) fields."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        out += leaves(f.dataType, name + ".") if isinstance(f.dataType, T.StructType) else [(name, f.dataType)]
    return out


def _get(doc: Column, path: str) -> Column:
    return reduce(lambda c, p: c.getField(p), path.split("."), doc)


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows added, removed or modified: _id, change, before, after and changed (paths with both values as JSON)."""
    names = list(dict.fromkeys(_fields(before) + _fields(after)))
    a, b = _doc(before, "before", names), _doc(after, "after", names)
    both = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), "_id", "full_outer")
    in_a, in_b = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    items = []
    paths = {p: t for p, t in leaves(both.schema["before"].dataType)} | {p: t for p, t in leaves(both.schema["after"].dataType)}
    have = {s: {p for p, _ in leaves(both.schema[s].dataType)} for s in ("before", "after")}
    for p in paths:
        x, y = (_get(F.col(s), p) if p in have[s] else F.lit(None) for s in ("before", "after"))
        one = F.struct(F.lit(p).alias("path"), _json(x, paths[p]).alias("from"), _json(y, paths[p]).alias("to"))
        items.append(F.when(~x.eqNullSafe(y), one))
    changed = F.filter(F.array(*items), lambda i: i.isNotNull())
    kind = F.when(~in_a, "added").when(~in_b, "removed").when(F.size(changed) > 0, "modified")
    out = both.select("_id", kind.alias("change"), "before", "after", changed.alias("changed"))
    return out.filter("change is not null")


def _json(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def status(head: DataFrame, working: DataFrame) -> DataFrame:
    """Number of rows of each kind of change against the last commit."""
    return diff(head, working).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _merge_value(base: Column, ours: Column, theirs: Column, t: T.DataType) -> tuple[Column, Column]:
    """(merged value, whether both sides changed it differently); structs merge field by field."""
    if isinstance(t, T.StructType):
        parts = {f.name: _merge_value(base.getField(f.name), ours.getField(f.name), theirs.getField(f.name), f.dataType) for f in t.fields}
        whole = base.isNotNull() & ours.isNotNull() & theirs.isNotNull()
        deep = F.struct(*[v.alias(k) for k, (v, _) in parts.items()])
        clash = reduce(lambda x, y: x | y, [c for _, c in parts.values()], F.lit(False))
        flat, flat_clash = _merge_flat(base, ours, theirs)
        return F.when(whole, deep).otherwise(flat), F.when(whole, clash).otherwise(flat_clash)
    return _merge_flat(base, ours, theirs)


def _merge_flat(base: Column, ours: Column, theirs: Column) -> tuple[Column, Column]:
    clash = ~_same(ours, base) & ~_same(theirs, base) & ~_same(ours, theirs)
    return F.when(_same(ours, base), theirs).otherwise(ours), clash


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, mode: str = "field") -> tuple[DataFrame, DataFrame]:
    """(merged rows, conflicts: _id, kind, base, ours, theirs).

    Rows that one side changed take that side. A row that one side removed and the
    other left alone goes; removed against changed is a conflict. Where both sides
    changed a row, ``field`` merges fields and conflicts where both changed one
    differently, ``row`` conflicts unless they made it equal, ``ours`` and ``theirs``
    let that side win every conflict. Conflicts keep our row until they are resolved.
    """
    if mode not in MODES:
        raise VersionError(f"unknown merge mode {mode}")
    names = list(dict.fromkeys(_fields(base) + _fields(ours) + _fields(theirs)))
    sides = {}
    for name, df in (("base", base), ("ours", ours), ("theirs", theirs)):
        sides[name] = _doc(df, name, names).withColumn(f"in_{name}", F.lit(True))
    types = {f.name: f.dataType for df in (base, theirs, ours) for f in df.schema.fields}
    doc = T.StructType([T.StructField(n, types[n]) for n in names])
    for name in sides:
        sides[name] = sides[name].withColumn(name, F.col(name).cast(doc))
    all_ = sides["base"].join(sides["ours"], "_id", "full_outer").join(sides["theirs"], "_id", "full_outer")
    b, o, t = (F.col(n) for n in ("base", "ours", "theirs"))
    in_b, in_o, in_t = (F.col(f"in_{n}").isNotNull() for n in ("base", "ours", "theirs"))
    same_o, same_t = (in_b == in_o) & _same(b, o), (in_b == in_t) & _same(b, t)
    equal = (in_o == in_t) & _same(o, t)
    merged, clashes = [], F.lit(False)
    for n in names:
        value, clash = _merge_value(b.getField(n), o.getField(n), t.getField(n), types[n])
        merged.append(value.alias(n))
        clashes = clashes | clash
    both_there = in_o & in_t
    field_wise = F.lit(mode in ("field", "ours", "theirs"))
    conflict = ~same_o & ~same_t & ~equal & F.when(both_there & in_b & field_wise, clashes).otherwise(F.lit(True))
    kind = F.when(~in_b, "both added").when(~in_o, "removed by us").when(~in_t, "removed by them").otherwise("both modified")
    if mode in ("ours", "theirs"):
        win, there = (o, in_o) if mode == "ours" else (t, in_t)
    else:
        win, there = o, in_o
    deep = both_there & in_b & ~same_o & ~same_t & ~equal & ~conflict
    value = F.when(conflict, win).when(same_o, t).when(same_t | equal, o).when(deep, F.struct(*merged)).otherwise(o)
    present = F.when(conflict, there).when(same_o, in_t).when(same_t | equal, in_o).otherwise(F.lit(True))
    decided = all_.select("_id", value.alias("v"), present.alias("there"), conflict.alias("conflict"), kind.alias("kind"), "base", "ours", "theirs")
    rows = decided.filter("there").select("_id", *[F.col("v").getField(n).alias(n) for n in names])
    open_ = decided.filter("conflict" if mode in ("field", "row") else "false").select("_id", "kind", "base", "ours", "theirs")
    return rows, open_


def resolve(merged: DataFrame, conflicts: DataFrame, take: str | DataFrame) -> DataFrame:
    """The merged rows with every conflict settled: "ours", "theirs", or by given rows."""
    names = _fields(merged)
    if isinstance(take, DataFrame):
        chosen = take.select("_id", *names).join(conflicts.select("_id"), "_id", "left_semi")
    else:
        chosen = conflicts.filter(F.col(take).isNotNull()).select("_id", *[F.col(take).getField(n).alias(n) for n in names])
    return merged.join(conflicts.select("_id"), "_id", "left_anti").unionByName(chosen)


class Repository:
    """Commits, branches and tags of named collections."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.log_path = f"{root}/log.json"
        self.state = self._load()

    # the log

    def _load(self) -> dict[str, Any]:
        text = files.read_text(self.spark, self.log_path)
        return json.loads(text) if text else {"commits": {}, "branches": {"main": None}, "tags": {}, "head": "main"}

    def _store(self) -> None:
        """The log is replaced whole, in one step."""
        files.write_text(self.spark, self.log_path, json.dumps(self.state, indent=1))

    # revisions

    def resolve(self, rev: str) -> str:
        """A commit id for HEAD, a branch, a tag or an id's prefix, with ~n and ^n steps."""
        m = re.fullmatch(r"([^~^]+)((?:~\d*|\^\d*)*)", rev)
        if not m:
            raise VersionError(f"malformed revision {rev}")
        name, steps = m[1], re.findall(r"([~^])(\d*)", m[2])
        s = self.state
        name = s["head"] if name == "HEAD" else name
        at = s["branches"].get(name) or s["tags"].get(name)
        if at is None:
            found = [c for c in s["commits"] if c.startswith(name)]
            if len(found) != 1:
                raise VersionError(f"unknown revision {rev}")
            at = found[0]
        for kind, n in steps:
            count = int(n) if n else 1
            for _ in range(count if kind == "~" else min(count, 1)):
                parents = s["commits"][at]["parents"]
                pick = count - 1 if kind == "^" else 0
                if pick >= len(parents):
                    raise VersionError(f"{rev} has no such parent")
                at = parents[pick]
        return at

    def ancestors(self, commit: str | None) -> list[str]:
        """A commit and all it descends from, newest first."""
        seen, todo = {}, [commit] if commit else []
        while todo:
            c = todo.pop()
            if c not in seen:
                seen[c] = self.state["commits"][c]["n"]
                todo += self.state["commits"][c]["parents"]
        return sorted(seen, key=lambda c: -seen[c])

    def merge_base(self, a: str, b: str) -> str | None:
        other = set(self.ancestors(b))
        return next((c for c in self.ancestors(a) if c in other), None)

    # commands

    def commit(self, collections: dict[str, DataFrame], message: str, author: str = "", branch: str | None = None, parents: list[str] | None = None) -> str:
        """Write the given collections as snapshots; others are carried over from the parent."""
        s = self.state
        branch = branch or s["head"]
        tip = s["branches"].get(branch)
        parents = parents if parents is not None else [tip] if tip else []
        n = len(s["commits"])
        seed = json.dumps([n, parents, message, author, sorted(collections), dt.datetime.now(dt.UTC).isoformat()])
        id_ = hashlib.sha1(seed.encode()).hexdigest()
        tables = dict(s["commits"][parents[0]]["tables"]) if parents else {}
        for name, df in collections.items():
            path = f"{self.root}/snapshots/{id_}/{name}"
            df.write.parquet(path)
            tables[name] = path
        s["commits"][id_] = {"n": n, "parents": parents, "message": message, "author": author, "tables": tables, "time": dt.datetime.now(dt.UTC).isoformat()}
        s["branches"][branch] = id_
        self._store()
        return id_

    def read(self, name: str, rev: str = "HEAD") -> DataFrame:
        tables = self.state["commits"][self.resolve(rev)]["tables"]
        if name not in tables:
            raise VersionError(f"{rev} has no collection {name}")
        return self.spark.read.parquet(tables[name])

    def branch(self, name: str, at: str = "HEAD") -> None:
        if name in self.state["branches"]:
            raise VersionError(f"branch {name} is there already")
        self.state["branches"][name] = self.resolve(at)
        self._store()

    def delete_branch(self, name: str) -> None:
        if name == self.state["head"]:
            raise VersionError("the current branch cannot be deleted")
        del self.state["branches"][name]
        self._store()

    def branches(self) -> dict[str, str | None]:
        return dict(self.state["branches"])

    def checkout(self, name: str) -> None:
        if name not in self.state["branches"]:
            raise VersionError(f"unknown branch {name}")
        self.state["head"] = name
        self._store()

    def tag(self, name: str, at: str = "HEAD") -> None:
        self.state["tags"][name] = self.resolve(at)
        self._store()

    def delete_tag(self, name: str) -> None:
        del self.state["tags"][name]
        self._store()

    def reset(self, rev: str, branch: str | None = None) -> None:
        self.state["branches"][branch or self.state["head"]] = self.resolve(rev)
        self._store()

    def branch_status(self, a: str, b: str) -> tuple[int, int]:
        """(commits that only a has, commits that only b has)."""
        x, y = set(self.ancestors(self.resolve(a))), set(self.ancestors(self.resolve(b)))
        return len(x - y), len(y - x)

    def log(self, rev: str = "HEAD", collection: str | None = None, filter: dict[str, Any] | None = None, changed: str | None = None, limit: int | None = None) -> list[dict[str, Any]]:
        """Commits from a revision back; with a filter those that touch a matching row (before or after)."""
        from ..functions.core import Ctx
        from ..plans.filters import compile_filter

        out = []
        for c in self.ancestors(self.resolve(rev)):
            info = self.state["commits"][c]
            if collection is not None:
                parent = info["parents"][0] if info["parents"] else None
                was = self.state["commits"][parent]["tables"].get(collection) if parent else None
                now = info["tables"].get(collection)
                if was == now:
                    continue
                after = self.spark.read.parquet(now)
                before = self.spark.read.parquet(was) if was else after.limit(0)
                found = diff(before, after)
                if filter:
                    hits = [d.filter(compile_filter(filter, Ctx(d))).select("_id") for d in (before, after)]
                    found = found.join(hits[0].union(hits[1]).distinct(), "_id", "left_semi")
                if changed:
                    found = found.filter(F.exists("changed", lambda x: x["path"] == changed))
                if found.isEmpty():
                    continue
            out.append({"commit": c, **{k: info[k] for k in ("parents", "message", "author", "time")}})
            if limit and len(out) == limit:
                break
        return out

    def diff(self, name: str, a: str, b: str) -> DataFrame:
        return diff(self.read(name, a), self.read(name, b))

    def _at(self, name: str, commit: str | None, like: DataFrame) -> DataFrame:
        path = self.state["commits"][commit]["tables"].get(name) if commit else None
        return self.spark.read.parquet(path) if path else like.limit(0)

    def merge(self, theirs: str, mode: str = "field", message: str = "", ff: bool = True, author: str = "") -> tuple[str | None, dict[str, DataFrame]]:
        """(new tip, conflicts by collection); with conflicts nothing is committed."""
        if self.state.get("merging"):
            raise VersionError("a merge is open: continue or abort it first")
        ours, other = self.resolve("HEAD"), self.resolve(theirs)
        base = self.merge_base(ours, other)
        if base == other:
            return ours, {}
        if base == ours and ff:
            self.reset(other)
            return other, {}
        done = self._apply(base, ours, other, mode, message or f"merge {theirs}", [ours, other], author)
        if done[1]:  # kept in the log, so another session can go on with it
            self.state["merging"] = {"base": base, "ours": ours, "theirs": other, "mode": mode, "message": message or f"merge {theirs}", "author": author}
            self._store()
        return done

    def conflicts(self) -> dict[str, DataFrame]:
        """Conflicts of the open merge by collection."""
        m = self._merging()
        return self._apply(m["base"], m["ours"], m["theirs"], m["mode"], m["message"], [])[1]

    def _merging(self) -> dict[str, Any]:
        if not self.state.get("merging"):
            raise VersionError("no merge is open")
        return self.state["merging"]

    def merge_continue(self, take: str | dict[str, str | DataFrame]) -> str:
        """Commit the open merge with every conflict settled: "ours", "theirs" or rows, for all collections or each."""
        m = self._merging()
        if self.resolve("HEAD") != m["ours"]:
            raise VersionError("the branch has moved since the merge began")
        tip, _ = self._apply(m["base"], m["ours"], m["theirs"], m["mode"], m["message"], [m["ours"], m["theirs"]], m["author"], take)
        del self.state["merging"]
        self._store()
        return tip

    def merge_abort(self) -> None:
        """Forget the open merge; the branch is as it was."""
        self._merging()
        del self.state["merging"]
        self._store()

    def log_page(self, size: int, after: str | None = None, rev: str = "HEAD") -> tuple[list[dict[str, Any]], str | None]:
        """(commits, where the next page goes on); a page stays the same while new commits arrive.

        ``after`` is a token that the last page gave: it names where the walk began and how far it is.
        """
        tip, done = (after.split(":") if after else (self.resolve(rev), "0"))
        walk = self.ancestors(tip)
        page = walk[int(done) : int(done) + size]
        infos = [{"commit": c, **{k: self.state["commits"][c][k] for k in ("parents", "message", "author", "time")}} for c in page]
        end = int(done) + len(page)
        return infos, f"{tip}:{end}" if end < len(walk) else None

    def stat(self, rev: str = "HEAD") -> dict[str, dict[str, int]]:
        """Rows added, removed and modified by a commit, for each collection that it touches."""
        c = self.resolve(rev)
        info = self.state["commits"][c]
        parent = info["parents"][0] if info["parents"] else None
        was = self.state["commits"][parent]["tables"] if parent else {}
        out = {}
        for name in sorted({*info["tables"], *was}):
            if info["tables"].get(name) != was.get(name):
                after = self._at(name, c, self._at(name, parent, None)) if name not in info["tables"] else self._at(name, c, None)
                found = diff(self._at(name, parent, after), after).groupBy("change").count().collect()  # three rows at most
                out[name] = {r["change"]: r["count"] for r in found}
        return out

    def _apply(self, base, ours, theirs, mode, message, parents, author="", take=None):
        commits = self.state["commits"]
        done, open_ = {}, {}
        for name in sorted({*commits[ours]["tables"], *commits[theirs]["tables"]}):
            paths = [commits[c]["tables"].get(name) if c else None for c in (base, ours, theirs)]
            if paths[2] == paths[0] or paths[1] == paths[2]:
                continue
            like = self.spark.read.parquet(paths[1] or paths[2])
            merged, conflicts = three_way(*(self._at(name, c, like) for c in (base, ours, theirs)), mode)
            if mode in ("field", "row") and not conflicts.isEmpty():
                how = take.get(name) if isinstance(take, dict) else take
                if how is None:
                    open_[name] = conflicts
                else:
                    merged = resolve(merged, conflicts, how)
            done[name] = merged
        if open_:
            return None, open_
        return self.commit(done, message, author, parents=parents), {}

    def cherry_pick(self, rev: str, mode: str = "field") -> tuple[str | None, dict[str, DataFrame]]:
        """The change of one commit on top of the current branch."""
        c = self.resolve(rev)
        parents = self.state["commits"][c]["parents"]
        tip = self.resolve("HEAD")
        return self._apply(parents[0] if parents else None, tip, c, mode, self.state["commits"][c]["message"], [tip])

    def revert(self, rev: str, mode: str = "field") -> tuple[str | None, dict[str, DataFrame]]:
        """The inverse of one commit's change on top of the current branch."""
        c = self.resolve(rev)
        parents = self.state["commits"][c]["parents"]
        if not parents:
            raise VersionError("the first commit cannot be reverted")
        tip = self.resolve("HEAD")
        return self._apply(c, tip, parents[0], mode, f"revert {rev}", [tip])

    def rebase(self, onto: str, mode: str = "field") -> tuple[str | None, dict[str, DataFrame]]:
        """The current branch's own commits again, on top of another."""
        tip, target = self.resolve("HEAD"), self.resolve(onto)
        base = self.merge_base(tip, target)
        own = [c for c in self.ancestors(tip) if c not in set(self.ancestors(base))][::-1]
        self.reset(target)
        last: str | None = target
        for c in own:
            last, open_ = self.cherry_pick(c, mode)
            if open_:
                self.reset(tip)
                return None, open_
        return last, {}

    def gc(self) -> list[str]:
        """Delete snapshots that no branch or tag reaches."""
        live = {c for tip in [*self.state["branches"].values(), *self.state["tags"].values()] for c in self.ancestors(tip)}
        gone = [c for c in self.state["commits"] if c not in live]
        used = {p for c in live for p in self.state["commits"][c]["tables"].values()}
        for c in gone:
            for path in self.state["commits"][c]["tables"].values():
                if path not in used:
                    files.remove(self.spark, path)
            del self.state["commits"][c]
        self._store()
        return gone
