from tests.conftest import spark, tmpdir_path  # noqa: F401
