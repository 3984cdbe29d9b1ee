"""Part of lumenspan."""
