import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Intermediate tables of the tests go to a folder of their own unless the session names one."""
    from actuspark.session import CHECKPOINT_KEY

    if not spark.conf.get(CHECKPOINT_KEY, None):
        spark.conf.set(CHECKPOINT_KEY, str(tmp_path_factory.mktemp("shared")))
