"""A small table of sentences with personal data marked by hand, most of it such as the fixed patterns reject.

A mark is `{kind|value}`. Words outside marks are none of the kinds: dates, prices, versions, numbers of pages and orders.
"""

from __future__ import annotations

import re

# Made by hand, addresses and numbers of no one.
ROWS = [
    "Please write to {email|anna.berg@mailhost} before Friday.",
    "Ask {email|root@localhost} for the password.",
    "My address is {email|tom_reed(at)example.org} at work.",
    "Send it to {email|info[at]example.com} or call us.",
    "Mail {email|j.doe(at)mail.example.net} today",
    "It came from {email|backup@fileserver} at night.",
    "Contact: {email|sales[at]shop.example}.",
    "Reach me under {email|m.lopez@intranet}, please",
    "Both {email|ann@home.example.org} and {email|bo@office} replied.",
    "mail {email|kim.lee42(at)example.com}, then wait",
    "Tell {email|eva(at)shop.example.org} about it.",
    "Write {email|max(at)example.net}, not me",
    "Is {email|ute(at)mail.firm.example} yours?",
    "her address: {email|li.wei[at]example.org}",
    "Forward it to {email|support@helpdesk} first",
    "The host {ip|2001:db8:0:0:8a2e:370:7334:1} did not answer.",
    "Login from {ip|fe80:0:0:0:1ff:fe23:4567:890a} failed",
    "We saw {ip|2001:db8:85a3:0:0:8a2e:370:7334} again.",
    "Blocked {ip|10.20.30.*} and {ip|192.168.7.12} last week.",
    "Requests from {ip|2001:db8:0:12:5:66:7:8} and {ip|2001:db8:aa:bb:cc:dd:ee:ff} were dropped.",
    "Route {ip|192.168.1.*} to the gateway, not {ip|172.16.3.*}.",
    "The range {ip|10.4.0.*} is free",
    "The server at {ip|172.16.254.1} is down.",
    "Your card {card|4929 3483 8614 6301} was charged.",
    "Card number {card|4111-1111-1111-1112} has expired",
    "Pay with {card|5500.0055.5555.5559} now.",
    "He used {card|3782 822463 10005} in the shop.",
    "The number {card|4111.1111.1111.1111} is a test.",
    "card {card|5105 1051 0510 5101}, valid until 09/27",
    "Old card: {card|6011-0009-9013-9425}.",
    "I lost my card {card|371449635398432} on the train.",
    "Call {phone|(017) 555-7713} after six.",
    "Phone: {phone|017-555-7713}.",
    "Dial {phone|0049-30-901820} for help",
    "My number is {phone|555-7713}, ask for Ann.",
    "Ring {phone|(030) 901-8204} or {phone|+49 30 9018204} in the morning.",
    "fax {phone|017/555-7714} only",
    "Our hotline {phone|0800-555-019} is free.",
    "Text {phone|202-555-0143} to vote.",
    "Her number {phone|646-555-0102}, if you need it.",
    "tel {phone|555-0134}",
    "Call {phone|555-0178} or {phone|555-0179} today.",
    "Phone {phone|(040) 555-3321} before noon.",
    "Reach the office at {phone|(202) 555-0188}.",
    "The meeting on 2024-01-05 starts at 10:30 in room 12.",
    "In 1998 and 2003 they sold 1,299 books for 25.50 each.",
    "Version 3.11.2 replaces 3.10 and 2.7.",
    "See pages 12-17 and 203-219 of volume 4.",
    "Order 48213 has 3 parts and costs 1,299.00 dollars.",
    "About 45% of 2,000 people live in 7 towns.",
    "It was 05/11/2019 or 6.11.2019, not later.",
    "The score was 3:2 after 90 minutes.",
    "Meet @home at 8, bring 2 bags.",
    "Follow @example_news for more.",
    "Article 12(3) and section 4.2.1 apply since 2016.",
    "Model A4-2000 weighs 1500 kg, the X-200 only 980.",
    "ISO 9001 and RFC 2822 are standards.",
    "They won 21-19 and 21-7 in 1987.",
    "Add 250 g of flour, 2 eggs and 100 ml of milk.",
    "Ticket #4821 was closed in 2021, #4822 was not.",
    "The distance is 384,400 km, or 238,855 miles.",
    "Between 1914 and 1918 some 9 million died.",
    "chapter 3 has 42 pages, chapter 4 has 1042",
    "The year 2000 had 366 days.",
    "Lines 100 200 300 are free.",
    "From 9:00 to 17:30 the shop is open, on 24.12. until 14:00.",
    "The train 1234 leaves from platform 5 at 07:45.",
    "n=1000, p<0.05, see table 2",
    "Part 555 of lot 7713 is missing.",
    "He paid 12.5 @ 3 percent.",
]

_MARK = re.compile(r"\{(\w+)\|([^}]*)\}")


def unmarked(row: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text of a row, and its marks as (kind, start, stop)."""
    text, marks, upto = "", [], 0
    for m in _MARK.finditer(row):
        text += row[upto : m.start()]
        marks.append((m[1], len(text), len(text) + len(m[2])))
        text, upto = text + m[2], m.end()
    return text + row[upto:], marks


def exchanged(rows: list[str], turns: int) -> list[str]:
    """`turns` copies of the rows; in each after the first the marks of a kind pass their values on to one another, each
    time by another distance, so that a value's shape is learned apart from the sentence around it."""
    values: dict[str, list[str]] = {}
    for row in rows:
        for kind, value in _MARK.findall(row):
            values.setdefault(kind, []).append(value)
    copies = []
    for turn in range(turns):
        place = dict.fromkeys(values, 0)

        def other(mark: re.Match, turn: int = turn, place: dict[str, int] = place) -> str:
            own = values[mark[1]]
            place[mark[1]] += 1
            return f"{{{mark[1]}|{own[(place[mark[1]] - 1 + turn * (turn + 1) // 2) % len(own)]}}}"

        copies += [_MARK.sub(other, row) for row in rows]
    return copies
