"""Where the tables are."""

import os

DATA = os.environ.get("TEST_DATA", "/root/testdata")
