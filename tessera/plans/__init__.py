"""Whole runs: renderers, the process facade and the registered queries."""
