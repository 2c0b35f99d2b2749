"""Runnable jobs: each has a command line, a small configuration, and a function that takes a session and plain paths."""
