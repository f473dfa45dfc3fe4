"""Operators for preparing training text: cleaning, scanning, formatting, mixing and sharding."""
