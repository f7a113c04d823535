import sys

from siltstone.cli import main

sys.exit(main())
