"""Package: functions."""
