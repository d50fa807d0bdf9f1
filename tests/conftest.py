import pytest

from grainsift.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows_of():
    """Rows of a table as sorted tuples, for order-free comparison."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
