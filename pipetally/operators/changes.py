"""Inserts, updates and deletes as new snapshots; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def append_rows(df: DataFrame, new: DataFrame, as_of: Column | None = None, id_col: str | None = None) -> DataFrame:
    """``df`` and the new rows; columns that ``new`` lacks are null, an id it lacks is drawn, times it lacks are ``as_of``.

    Drawn ids differ at every evaluation, so write the result before it is used twice.
    """
    if id_col and id_col not in new.columns:
        new = new.withColumn(id_col, F.expr("uuid()"))
    for c in ("created_at", "updated_at"):
        if as_of is not None and c in df.columns and c not in new.columns:
            new = new.withColumn(c, as_of)
    return df.unionByName(new, allowMissingColumns=True)


def apply_updates(df: DataFrame, changes: DataFrame, key: Sequence[str], as_of: Column | None = None, given: str | None = None) -> DataFrame:
    """``df`` with the columns of ``changes`` (one row a key); ``updated_at`` becomes ``as_of``.

    ``given`` names an array column of ``changes`` with the fields that a change sets, which may be set to
    null; without it those that are not null are set.
    """
    fields = [c for c in changes.columns if c not in key and c != given]
    side = changes.select(*key, *[F.col(c).alias(f"__{c}") for c in fields], *([F.col(given).alias("__given")] if given else []), F.lit(True).alias("__hit"))
    out = df.join(side, list(key), "left")
    is_set = lambda c: F.coalesce(F.array_contains("__given", c), F.lit(False)) if given else F.col(f"__{c}").isNotNull()
    cols = [F.when(is_set(c), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns]
    if as_of is not None and "updated_at" in df.columns:
        cols = [F.when(F.col("__hit"), as_of).otherwise(F.col("updated_at")).alias("updated_at") if n == "updated_at" else c for n, c in zip(df.columns, cols)]
    return out.select(*cols)


def set_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """A partial update of the rows that meet a condition."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def counted_write(df: DataFrame, ok: Column, write: Callable[[DataFrame], None], problem: Column | None = None) -> DataFrame:
    """Write the rows of ``df`` that are ``ok`` (null: not), and return (written, failed) of that write, a row.

    The counts are observed on the rows as they pass on to the writer, so nothing is read again.  With
    ``problem``, a text for each failed row, the row also has ``first_problem``, the least of them.
    """
    seen, good = Observation(), F.coalesce(ok, F.lit(False))
    told = F.min(F.when(~good, F.lit(None).cast("string") if problem is None else problem)).alias("first_problem")
    write(df.observe(seen, F.count_if(good).alias("written"), F.count_if(~good).alias("failed"), told).filter(good))
    got = seen.get
    kinds = "written long, failed long" + (", first_problem string" if problem is not None else "")
    return df.sparkSession.createDataFrame([(got["written"], got["failed"], *([got["first_problem"]] if problem is not None else []))], kinds)


def delete_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` without the keys; a key that is not there is no error."""
    return df.join(keys.select(key).distinct(), key, "left_anti").select(*df.columns)


class ForeignKey(NamedTuple):
    """``child``.``column`` refers to ``parent``.``key``; the child's row goes with the parent's."""

    child: str
    column: str
    parent: str
    key: str = "id"


def parents_first(keys: Sequence[ForeignKey]) -> list[str]:
    """The tables of a foreign-key graph, each after all that it refers to; a cycle is an error."""
    left = {t: {k.parent for k in keys if k.child == t} for k in keys for t in (k.child, k.parent)}
    out: list[str] = []
    while left:
        ready = [t for t, needs in left.items() if needs <= set(out)]
        if not ready:
            raise ValueError(f"foreign keys in a cycle: {', '.join(sorted(left))}")
        out += ready
        left = {t: needs for t, needs in left.items() if t not in ready}
    return out


#: A join sorts about so many rows in a task.
ROWS_A_TASK = 500_000
#: Keys of a table of at most so many rows are broadcast.
BROADCAST_ROWS = 1_000_000


def dealt(df: DataFrame, column: str, rows: int | None) -> DataFrame:
    """``df``, of about so many ``rows``, by ``column`` over tasks of about ``ROWS_A_TASK``, if the session's shuffle partitions would be larger."""
    parts = -(-(rows or 0) // ROWS_A_TASK)
    return df.repartition(parts, column) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def cascade(tables: dict[str, DataFrame], keys: Sequence[ForeignKey], gone: dict[str, DataFrame], rows: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """``tables`` without the rows that ``gone`` names (by key, for each table) and all that refer to them, at any depth.

    Level by level, parents first: a row goes if it is named, or if one of its references goes; a null
    reference stays, and so does one to a row that is not there.  Only keys travel, and of a table that no
    other refers to, none.  Keys that are not in their table are no error.  ``rows``, the sizes of tables as far
    as they are known, bound what a task of a join holds by more tasks for larger tables.
    """
    sizes = rows or {}
    out, dead = dict(tables), {}  # dead: for each (table, key) that others refer to, the keys that go
    for t in [*[t for t in parents_first(keys) if t in tables], *[t for t in gone if not any(t in (k.child, k.parent) for k in keys)]]:
        df, named = tables[t], gone.get(t)
        refers = [k for k in keys if k.child == t and (k.parent, k.key) in dead]
        lost = [(k.column, dead[k.parent, k.key]) for k in refers]
        if named is not None:
            lost.append((named.columns[0], named.select(named.columns[0]).distinct()))
        if not lost:
            continue
        known = {k.column: sizes.get(k.parent) for k in refers}

        def joined(left: DataFrame, column: str, goes: DataFrame, how: str) -> DataFrame:
            most = known.get(column)
            if most is not None and most <= BROADCAST_ROWS:
                return left.join(F.broadcast(goes.toDF(column)), column, how)
            return dealt(left, column, sizes.get(t)).join(goes.toDF(column), column, how)

        left = df
        for column, goes in lost:
            left = joined(left, column, goes, "left_anti")
        out[t] = left.select(*df.columns)
        for key in sorted({k.key for k in keys if k.parent == t}):
            went = [joined(df, column, goes, "left_semi").select(key) for column, goes in lost]
            dead[t, key] = reduce(DataFrame.unionByName, went).filter(F.col(key).isNotNull()).distinct()
    return out


def delete_cascade(parents: DataFrame, children: Sequence[DataFrame], gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, list[DataFrame]]:
    """Parents without ``gone`` and children without those of a parent that went; a null reference stays."""
    ids = gone.select(F.col(key).alias(foreign))
    return delete_rows(parents, gone, key), [delete_rows(c, ids, foreign) for c in children]


def insert_if_absent(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``df`` and those new rows whose key it does not hold; of new rows with one key the first by value."""
    first = F.min(F.struct(key, *[c for c in new.columns if c != key])).alias("__row")
    once = new.groupBy(F.col(key).alias("__key")).agg(first).select("__row.*")
    return df.unionByName(once.join(df.select(key), key, "left_anti").select(*new.columns), allowMissingColumns=True)


def schema_aware_update(df: DataFrame, condition: Column, payload: dict[str, Column]) -> DataFrame:
    """A partial update that leaves out the columns that the table does not have."""
    return set_where(df, condition, {c: v for c, v in payload.items() if c in df.columns})


def with_missing_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with null columns for those that an older schema lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def column_or(df: DataFrame, column: str, default: object) -> Column:
    """A column, or ``default`` where it is null or the table has no such column."""
    return F.coalesce(F.col(column), F.lit(default)) if column in df.columns else F.lit(default)


# A profile belongs to the user of its id, every other row to that of its ``user_id``; each command has a policy of its own.
OWNERS = {"profiles": "id", "applications": "user_id", "contacts": "user_id", "interview_rounds": "user_id", "tasks": "user_id", "documents": "user_id"}
COMMANDS = ("select", "insert", "update", "delete")
#: (table, command): the column that must be the user's.
POLICIES = {(t, c): owner for t, owner in OWNERS.items() for c in COMMANDS}
FOREIGN = "new row violates row-level security policy for table "


def _policy(table: str, command: str, policies: dict[tuple[str, str], str]) -> str:
    if (table, command) not in policies:
        raise ValueError(f"no policy for {command} on {table}: nobody may")
    return policies[table, command]


def visible(df: DataFrame, table: str, user: Column, command: str = "select", policies: dict[tuple[str, str], str] = POLICIES) -> DataFrame:
    """The rows of ``table`` on which ``user`` (a literal, or a column for requests of many users) may use a command."""
    return df.filter(F.coalesce(F.col(_policy(table, command, policies)) == user, F.lit(False)))


def _split_own(rows: DataFrame, owner: Column, user: Column, table: str) -> tuple[DataFrame, DataFrame]:
    own = F.coalesce(owner == user, F.lit(False))
    return rows.filter(own), rows.filter(~own).withColumn("error", F.lit(FOREIGN + table))


def checked_insert(new: DataFrame, table: str, user: Column, policies: dict[tuple[str, str], str] = POLICIES) -> tuple[DataFrame, DataFrame]:
    """(rows that ``user`` may insert, the others with ``error``)."""
    return _split_own(new, F.col(_policy(table, "insert", policies)), user, table)


def checked_update(df: DataFrame, changes: DataFrame, table: str, key: Sequence[str], user: str, policies: dict[tuple[str, str], str] = POLICIES) -> tuple[DataFrame, DataFrame]:
    """(``df`` after the ``changes`` that may be made, refused changes with ``error``).

    ``changes`` have the key, new values (null: unchanged) and the column ``user``, who asks.  A row that is
    not the user's is not there for them: such a change does nothing and is no error.  A change that would
    give an own row away is refused.
    """
    owner = _policy(table, "update", policies)
    held = df.select(*key, F.col(owner).alias("__owner"))
    near = changes.join(held, list(key)).filter(F.col(user) == F.col("__owner"))
    after = F.coalesce(F.col(owner), F.col("__owner")) if owner in changes.columns and owner not in key else F.col("__owner")
    good, bad = _split_own(near, after, F.col(user), table)
    return apply_updates(df, good.drop("__owner", user), key), bad.drop("__owner")


def checked_delete(df: DataFrame, asked: DataFrame, table: str, key: Sequence[str], user: str, policies: dict[tuple[str, str], str] = POLICIES) -> DataFrame:
    """``df`` without the rows that ``asked`` (the key and ``user``) names and that are the user's; others stay, without an error."""
    owner = _policy(table, "delete", policies)
    who = asked.select(*key, F.col(user).alias("__user")).distinct()
    gone = df.select(*key, F.col(owner).alias("__owner")).join(who, list(key)).filter("__owner = __user").select(*key).distinct()
    return df.join(gone, list(key), "left_anti").select(*df.columns)


def tenant_view(df: DataFrame, user_id: object, key: str = "user_id") -> DataFrame:
    """What one tenant may see."""
    return df.filter(F.col(key) == F.lit(user_id))
