"""Signals, statistics and window helpers as DataFrame functions."""
