"""No database is started: the options and the order of the calls are checked."""

import pytest

from delaylake.config import JdbcTarget
from delaylake.operators.gold import FACT_COLUMNS
from delaylake.sources import jdbc


class Database:
    """Stands in for the frame's writer and the session's reader, and counts rows."""

    def __init__(self, rows, lose=0, present=0):
        self.rows, self.lose, self.present, self.calls = rows, lose, present, []
        self.columns = list(FACT_COLUMNS)
        self.sparkSession = self.read = self.write = self

    def format(self, name):
        self.calls.append(("format", name))
        return self

    def options(self, **options):
        self.calls.append(("options", options))
        return self

    def option(self, name, value):
        self.calls.append(("option", name, value))
        return self

    def mode(self, name):
        self.calls.append(("mode", name))
        self.present = self.present if name == "append" else 0
        return self

    def save(self):
        self.present += self.rows - self.lose

    def load(self):
        return self

    def first(self):
        return {"n": self.present}

    def count(self):
        return self.rows


TARGET = JdbcTarget("jdbc:x:y", "facts", user="u", password="secret", driver="d.D")


def test_replaces_by_default_and_is_repeatable():
    base = Database(10, present=4)
    assert [jdbc.load_fact(base, TARGET) for _ in range(2)] == [10, 10]
    given = {k: v for c in base.calls if c[0] == "options" for k, v in c[1].items()}
    assert given["batchsize"] == "5000" and given["truncate"] == "true"
    assert given["numPartitions"] == "32" and given["dbtable"] == "facts"
    assert "airline VARCHAR(10)" in given["createTableColumnTypes"]
    assert ("mode", "overwrite") in base.calls and ("mode", "append") not in base.calls


def test_append_adds():
    assert jdbc.load_fact(Database(10, present=4), TARGET, append=True) == 14


@pytest.mark.parametrize("lose", [1, -1])
def test_a_different_count_raises(lose):
    with pytest.raises(RuntimeError, match="load again"):
        jdbc.load_fact(Database(10, lose=lose), TARGET)


def test_credentials_come_from_the_environment_and_are_not_shown():
    assert JdbcTarget.from_environment({}) is None
    env = {"DELAYLAKE_JDBC_URL": "jdbc:x", "DELAYLAKE_JDBC_USER": "me", "DELAYLAKE_JDBC_PASSWORD": "pw"}
    with pytest.raises(KeyError, match="TABLE"):
        JdbcTarget.from_environment(env)
    env["DELAYLAKE_JDBC_TABLE"] = "facts"
    target = JdbcTarget.from_environment(env)
    assert (target.user, target.password) == ("me", "pw")
    assert "pw" not in repr(target) and "me'" not in repr(target)


def test_absent_credentials_are_left_out():
    assert jdbc.connection_options(JdbcTarget("jdbc:x", "t")) == {"url": "jdbc:x"}
