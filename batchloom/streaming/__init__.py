"""The operators on streams; each gives what its batch twin gives on the rows seen so far."""
