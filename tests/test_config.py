import pytest
from pyspark.sql import functions as F

from tracelight.operators import history as HI
from tracelight.plans import config
from tracelight.sources import readers


def test_discovery(tmp_path):
    repo, home, other = tmp_path / "repo", tmp_path / "home", tmp_path / "other.toml"
    (home / ".config/tracelight").mkdir(parents=True)
    repo.mkdir()
    got = lambda env=None: config.discover(repo, env or {}, home)
    assert got() == config.Config() and got().retention is None and config.Retention().policy().min_commits == 100
    (home / config.OF_USER).write_text("[analysis]\nmax_pending_age_hours = 5\n")
    assert got().analysis == config.Analysis(5, 0.6)
    (repo / config.IN_REPOSITORY).write_text('[retention]\nmax_age_days = 30\nretain_refs = ["refs/heads/x"]\nunknown = 1\n')
    assert got().retention.policy().retain_refs == ("refs/heads/x",) and got().analysis.max_pending_age_hours == 24
    other.write_text("[privacy]\nenabled = false\n")
    assert got({config.VARIABLE: str(other)}).privacy.redactor().names == [] and got({config.VARIABLE: ""}).retention.max_age_days == 30
    with pytest.raises(ValueError, match="TRACELIGHT_CONFIG.*none.toml"):
        got({config.VARIABLE: str(tmp_path / "none.toml")})
    for bad in ("[privacy", "[privacy]\nenabled = 3", "[analysis]\nmax_pending_age_hours = -1", "[privacy]\ncustom_patterns = [{name = 'x'}]", "[retention]\nretain_refs = 'x'"):
        other.write_text(bad)
        with pytest.raises(ValueError):
            config.read(other)


def test_redactor_of_settings(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('[privacy]\ndisabled_patterns = ["EMAIL", "NONE"]\ncustom_patterns = [{name = "T", pattern = "T-[0-9]+"}, {name = "BAD", pattern = "("}]\n')
    r = config.read(f).privacy.redactor()
    assert "EMAIL" not in r.names and r.names[-1] == "T" and len(r.warnings) == 2 and "NONE" in r.warnings[0] and "BAD" in r.warnings[1]


def test_inputs_and_contexts(spark, tmp_path):
    (tmp_path / "x").write_text("a\nb")
    assert readers.redaction_input(spark, path=f"file://{tmp_path}/x").first().text == "a\nb" and readers.redaction_input(spark, "t").first().text == "t"
    for bad in ({}, {"text": "a", "path": "b"}):
        with pytest.raises(ValueError):
            readers.redaction_input(spark, **bad)
    df = spark.createDataFrame([(1, None), (2, (False, None, 0, None)), (3, (True, None, 0, None)), (4, (None, None, None, None)), (5, (False, None, 1, None)), (6, (False, "a", 0, None)), (7, (False, None, 0, 2))], "k int, c struct<plan_mode:boolean,subagent_id:string,agent_depth:smallint,plan_step:bigint>")
    assert [r.k for r in df.where(HI.is_default_context(F.col("c"))).orderBy("k").collect()] == [1, 2, 4]
