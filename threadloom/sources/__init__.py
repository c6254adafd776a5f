"""Message logs: read, write, import; and adapters that shape other tables into messages."""
