"""The circulation rules served one request at a time over plain Python rows: the brute force the jobs must equal."""

from __future__ import annotations

from datetime import timedelta
from decimal import Decimal

DAYS = {"standard": 14, "student": 21, "premium": 30}


def by_key(rows, key):
    return {r[key]: dict(r) for r in rows}


def issue(books, members, loans, requests, as_of):
    books, members, loans = by_key(books, "book_id"), by_key(members, "member_id"), [dict(r) for r in loans]
    outcomes, next_id = {}, max([r["loan_id"] for r in loans], default=0)
    for seq, book, member in sorted(requests):
        person = members.get(member)
        if person is None:
            outcomes[seq] = "Member not found"
        elif person["status"] != "active":
            outcomes[seq] = "Member is not active"
        elif any(
            r["book_id"] == book and r["member_id"] == member and r["return_date"] is None for r in loans
        ):
            outcomes[seq] = "Member already has an active loan for this specific book."
        elif books.get(book, {"available_copies": 0})["available_copies"] <= 0:
            outcomes[seq] = "No copies currently available."
        else:
            outcomes[seq] = None
            next_id += 1
            books[book]["available_copies"] -= 1
            due = as_of + timedelta(days=DAYS[person["membership_type"]])
            loans.append({"loan_id": next_id, "book_id": book, "member_id": member, "loan_date": as_of,
                          "due_date": due, "return_date": None, "renewed_count": 0})
    return outcomes, loans, list(books.values())


def give_back(books, loans, fines, requests, as_of):
    books, loans, fines = by_key(books, "book_id"), by_key(loans, "loan_id"), [dict(r) for r in fines]
    outcomes, next_id = {}, max([r["fine_id"] for r in fines], default=0)
    for seq, key in sorted(requests):
        loan = loans.get(key)
        if loan is None:
            outcomes[seq] = "Loan not found"
        elif loan["return_date"] is not None:
            outcomes[seq] = "Book already returned"
        else:
            outcomes[seq] = None
            loan["return_date"] = as_of
            books[loan["book_id"]]["available_copies"] += 1
            if as_of > loan["due_date"]:
                next_id += 1
                amount = Decimal("0.50") * (as_of - loan["due_date"]).days
                fines.append({"fine_id": next_id, "loan_id": key, "member_id": loan["member_id"], "amount": amount,
                              "issued_date": as_of, "paid": False, "paid_date": None})
    return outcomes, list(loans.values()), fines, list(books.values())


def renew(members, loans, requests):
    members, loans, outcomes = by_key(members, "member_id"), by_key(loans, "loan_id"), {}
    for seq, key in sorted(requests):
        loan = loans.get(key)
        if loan is None:
            outcomes[seq] = "Loan not found"
        elif loan["return_date"] is not None:
            outcomes[seq] = "Cannot renew a returned loan"
        elif loan["renewed_count"] >= 2:
            outcomes[seq] = "Maximum renewals reached"
        else:
            outcomes[seq] = None
            loan["renewed_count"] += 1
            loan["due_date"] += timedelta(days=DAYS[members[loan["member_id"]]["membership_type"]])
    return outcomes, list(loans.values())


def pay(fines, requests, as_of):
    fines, outcomes = by_key(fines, "fine_id"), {}
    for seq, key in sorted(requests):
        fine = fines.get(key)
        outcomes[seq] = "Fine not found" if fine is None else "Fine already paid" if fine["paid"] else None
        if outcomes[seq] is None:
            fine.update(paid=True, paid_date=as_of)
    return outcomes, list(fines.values())


def reserve(books, members, reservations, requests, as_of):
    known, members, queue = {b["book_id"] for b in books}, by_key(members, "member_id"), [dict(r) for r in reservations]
    outcomes, next_id = {}, max([r["reservation_id"] for r in queue], default=0)
    for seq, book, member in sorted(requests):
        if book not in known:
            outcomes[seq] = "Book not found"
        elif member not in members:
            outcomes[seq] = "Member not found"
        elif members[member]["status"] != "active":
            outcomes[seq] = "Member is not active"
        elif any(r["book_id"] == book and r["member_id"] == member for r in queue):
            outcomes[seq] = "Member already has a reservation for this book"
        else:
            outcomes[seq] = None
            next_id += 1
            place = max([r["queue_position"] for r in queue if r["book_id"] == book], default=0) + 1
            queue.append({"reservation_id": next_id, "book_id": book, "member_id": member, "reserved_date": as_of,
                          "queue_position": place, "notified": False})
    return outcomes, queue


def cancel(reservations, requests):
    queue, outcomes = by_key(reservations, "reservation_id"), {}
    for seq, key in sorted(requests):
        gone = queue.pop(key, None)
        outcomes[seq] = "Reservation not found" if gone is None else None
        for other in queue.values() if gone else ():
            if other["book_id"] == gone["book_id"] and other["queue_position"] > gone["queue_position"]:
                other["queue_position"] -= 1
    return outcomes, list(queue.values())


def notify(reservations, requests):
    queue, outcomes = by_key(reservations, "reservation_id"), {}
    for seq, key in sorted(requests):
        row = queue.get(key)
        outcomes[seq] = "Reservation not found" if row is None else "Already notified" if row["notified"] else None
        if outcomes[seq] is None:
            row["notified"] = True
    return outcomes, list(queue.values())


def desk(books, members, events, loans=()):
    """Interleaved issue, renew and return events in order of (ts, event_id): event -> (reason, due date, fine)."""
    left = {b["book_id"]: b["available_copies"] for b in books}
    members, outcomes = by_key(members, "member_id"), {}
    held = {(r["book_id"], r["member_id"]): [r["due_date"], r["renewed_count"]] for r in loans if not r["return_date"]}
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        pair, day = (e["book_id"], e["member_id"]), e["ts"].date()
        person = members.get(e["member_id"])
        loan = held.get(pair)
        if e["action"] == "issue":
            if person is None:
                result = ("Member not found", None, None)
            elif person["status"] != "active":
                result = ("Member is not active", None, None)
            elif loan:
                result = ("Member already has an active loan for this specific book.", None, None)
            elif left.get(e["book_id"], 0) <= 0:
                result = ("No copies currently available.", None, None)
            else:
                left[e["book_id"]] -= 1
                held[pair] = [day + timedelta(days=DAYS[person["membership_type"]]), 0]
                result = (None, held[pair][0], None)
        elif loan is None:
            result = ("Loan not found", None, None)
        elif e["action"] == "return":
            left[e["book_id"]] += 1
            late = (day - loan[0]).days
            result = (None, loan[0], Decimal("0.50") * late if late > 0 else None)
            del held[pair]
        elif loan[1] >= 2:
            result = ("Maximum renewals reached", loan[0], None)
        else:
            loan[0], loan[1] = loan[0] + timedelta(days=DAYS[person["membership_type"]]), loan[1] + 1
            result = (None, loan[0], None)
        outcomes[e["event_id"]] = result
    return outcomes
