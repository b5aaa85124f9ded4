from types import SimpleNamespace

import pytest

from lexiloom import session


def test_batches_to_python_are_bounded_unless_the_session_says_otherwise(spark):
    own = spark.newSession()
    own.conf.unset(session.BATCH_SETTING)
    assert own.conf.get(session.BATCH_SETTING) == session.DEFAULT_BYTES
    session.ready(own)
    assert own.conf.get(session.BATCH_SETTING) == session.BATCH_BYTES
    own.conf.set(session.BATCH_SETTING, "1m")
    session.ready(own)
    assert own.conf.get(session.BATCH_SETTING) == "1m"


def test_a_cluster_without_a_shared_folder_is_refused():
    def fake(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="all machines share"):
            session.shared_dir(fake(master))
