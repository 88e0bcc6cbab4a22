"""Set-based operators shared by the plans."""
