"""Readers that turn files into rows and declared fields."""
