"""Tessera: functions."""
