"""Places that tests read."""

import os

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")
