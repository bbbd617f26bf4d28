import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from platematch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # The tests' own machine is the whole cluster, so a local folder is shared.
    folder = str(tmp_path_factory.mktemp("stages"))
    return local_session("4", 4, **{"spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": folder})


@pytest.fixture(scope="session")
def shop(spark):
    from tests.shop import build_shop

    return build_shop(spark)


@pytest.fixture(scope="session")
def states(spark, shop):
    from platematch.operators import requirements
    from platematch.session import stage
    from tests.shop import requests

    return stage(requirements.request_states(requests(spark), shop), "states")


@pytest.fixture(scope="session")
def stock(shop):
    from platematch.operators import matching
    from platematch.session import stage

    return stage(matching.warehouse(shop), "stock")
