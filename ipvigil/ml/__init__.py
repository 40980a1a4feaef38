"""Repeat-offence classification and anomaly scoring."""
