import sys

from .cli import main

if __name__ == "__main__":
    piped = None if sys.stdin.isatty() else sys.stdin.buffer.read()
    sys.exit(main(sys.argv[1:], stdin=piped))
