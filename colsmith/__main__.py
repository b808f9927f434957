import sys

from colsmith.cli import main

sys.exit(main(sys.argv[1:]))
