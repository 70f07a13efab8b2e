"""Registered queries: each a function of (session, folder), most with equivalent portable SQL."""
