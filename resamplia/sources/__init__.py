"""Tables in and out: observed/predicted pairs, timing files, monitor files."""
