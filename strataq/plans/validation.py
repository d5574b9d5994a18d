"""Predicates over commands and paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions import shell
from strataq.plans.registry import query
from strataq.sources.session import ship
from strataq.sources.tables import Tables

_CASES = ["ls -la", "git log --oneline", "cat /etc/passwd", "ls; rm -rf /", "echo `whoami`", "FOO=bar git -C /tmp/x log", "git push", "curl http://x", "echo ${HOME}", "wc -l 'a b", "git config user.name x", "head /etcetera", "cat /tmp/../etc/passwd", "head //proc/self", "git -c a=b show /repo/../repo/x", "A=1 B=2", "/usr/bin/LS /root/..", "git config --list"]
#: What each of these is refused for, worked out by hand.
_REASONS = [None, None, "path", "operator", "operator", None, "git", "program", "operator", "malformed", "git", None, "path", "path", None, "empty", "path", None]
_SQL_CASES = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in _CASES) + "]"


def commands(t: Tables) -> DataFrame:
    """A command with a number for each event."""
    c = F.element_at(F.array(*map(F.lit, _CASES)), (F.col("event_id") % len(_CASES) + 1).cast("int"))
    return t.events.select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(c, F.lit(" "), "user_id")).otherwise(c).alias("command"))


_COMMANDS = f"(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN concat(c, ' ', user_id) ELSE c END AS command FROM (SELECT event_id, user_id, ({_SQL_CASES})[event_id % {len(_CASES)} + 1] AS c FROM events))"


@query("dangerous_command", r"SELECT event_id, regexp_matches(command, '[;&|]|`|\$[({]|\beval\b|\bexec\b|\bsource\b|^\s*\.[\s/]|\s>>?\s') AS dangerous FROM " + _COMMANDS)
def dangerous_command(t: Tables) -> DataFrame:
    return commands(t).select("event_id", shell.dangerous(F.col("command")).alias("dangerous"))


def _path(t: Tables) -> tuple[DataFrame, Column]:
    i = F.col("p_partkey") % 5
    path = F.when(i == 0, F.concat(F.lit("/etc/"), "p_brand")).when(i == 1, F.concat(F.lit("/etcetera/"), "p_brand")).when(i == 2, F.concat(F.lit("src/../"), "p_type")).when(i == 3, "/sys").otherwise(F.concat(F.lit("/repo/src/"), "p_name"))
    return t.part, path


_PATH = "(SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat('/etc/', p_brand) WHEN 1 THEN concat('/etcetera/', p_brand) WHEN 2 THEN concat('src/../', p_type) WHEN 3 THEN '/sys' ELSE concat('/repo/src/', p_name) END AS path FROM part)"


@query("sensitive_path", "SELECT p_partkey, regexp_matches(path, '^(/etc|/root|/boot|/usr/sbin|/proc|/sys)(/|$)') AS sensitive FROM " + _PATH)
def sensitive_path(t: Tables) -> DataFrame:
    df, path = _path(t)
    return df.select("p_partkey", shell.sensitive(path).alias("sensitive"))


@query("path_traversal_check", "SELECT p_partkey, contains(path, '..') OR regexp_matches(path, '^(/etc|/root|/boot|/usr/sbin|/proc|/sys)(/|$)') AS refused FROM " + _PATH)
def path_traversal_check(t: Tables) -> DataFrame:
    df, path = _path(t)
    return df.select("p_partkey", shell.traverses(path).alias("refused"))


@query("glob_check", r"SELECT event_id, regexp_matches(command, '[;&|`$(){}\\]') OR contains(command, '..') AS refused FROM " + _COMMANDS)
def glob_check(t: Tables) -> DataFrame:
    return commands(t).select("event_id", shell.bad_glob(F.col("command")).alias("refused"))


@query("within_repo", "SELECT p_partkey, path = '/repo' OR starts_with(path, '/repo/') AS inside FROM " + _PATH)
def within_repo(t: Tables) -> DataFrame:
    df, path = _path(t)
    return df.select("p_partkey", shell.within(path, F.lit("/repo")).alias("inside"))


_SQL_REASONS = "[" + ", ".join("NULL" if r is None else f"'{r}'" for r in _REASONS) + "]"


@query("validate_command", f"SELECT event_id, command, CASE WHEN i = 16 AND event_id % 7 = 0 THEN 'program' ELSE ({_SQL_REASONS})[i] END AS refusal FROM (SELECT *, event_id % {len(_CASES)} + 1 AS i FROM {_COMMANDS})")
def validate_command(t: Tables) -> DataFrame:
    """The first reason to refuse each command. Splitting like a shell has no SQL form, so the SQL lists what each of the
    commands is refused for (a number after assignments is a program)."""
    ship(t.spark)

    @F.pandas_udf("string")
    def why(commands_: pd.Series) -> pd.Series:
        known = {c: shell.refusal(c) for c in commands_.unique()}
        return commands_.map(known)

    return commands(t).select("event_id", "command", why("command").alias("refusal"))


@query("derive_mode", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'full+focus' WHEN event_id % 2 = 0 THEN 'full' WHEN event_id % 3 = 0 THEN 'focus' WHEN event_id % 5 = 0 THEN 'incremental' ELSE 'standard' END AS mode FROM events")
def derive_mode(t: Tables) -> DataFrame:
    full, focus, since = (F.col("event_id") % k == 0 for k in (2, 3, 5))
    mode = F.when(full & focus, "full+focus").when(full, "full").when(focus, "focus").when(since, "incremental").otherwise("standard")
    return t.events.select("event_id", mode.alias("mode"))


@query("preflight_rollup", "SELECT n_regionkey AS grp, bool_and(n_nationkey % 7 <> 0) AS all_ok, bool_and(n_nationkey % 7 <> 0 OR n_nationkey % 2 = 1) AS required_ok FROM nation GROUP BY 1")
def preflight_rollup(t: Tables) -> DataFrame:
    there, optional = F.col("n_nationkey") % 7 != 0, F.col("n_nationkey") % 2 == 1
    return t.nation.groupBy(F.col("n_regionkey").alias("grp")).agg(F.bool_and(there).alias("all_ok"), F.bool_and(there | optional).alias("required_ok"))
