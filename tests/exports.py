"""A small invented export, as files and as a ZIP."""

import csv
import io
import zipfile

PREAMBLE = 'Notes:\n"Some addresses may be missing, as people choose who sees them. See the help pages for more."\n\n'
HEADER = ["First Name", "Last Name", "URL", "Email Address", "Company", "Position", "Connected On"]
IN = "https://www.linkedin.com/in/"

FIRST = [
    ["Mara", "Quill", IN + "maraquill", "mara@quill.example", "Acme Corp", "Senior Engineer", "01 Jan 2023"],
    ["Teo", "Brandt", IN + "teobrandt", "", "Larkspur, Inc.", "Product Manager", "15 Mar 2022"],
    ["Odile", "Ferry", IN + "odileferry", "odile@ferry.example", "Paper Moon", "UX Designer", "20 Jun 2023"],
    ["Samir", "Holt", IN + "samirholt", "", "Rivermark Inc", "Data Analyst", "05 Nov 2016"],
    ["Wen", "Castor", IN + "wencastor", "wen@castor.example", "Highgrove", "DevOps Engineer", "10 Feb 2024"],
    ["Petra", "Lund", IN + "petralund", "", "Saltbox", "CEO", "01 Aug 2022"],
    ["Ivo", "Marsh", IN + "ivomarsh", "ivo@marsh.example", "Acme Corporation", "Staff Engineer", "25 Dec 2015"],
    ["Nadia", "Okoro", IN + "nadiaokoro", "", "Acme Corp", "Engineering Manager", "14 Jul 2021"],
    ["Kenji", "Arai", IN + "kenjiarai", "", "Tokiwa Systems K.K.", "Principal Architect", "03 Sep 2019"],
    ["Íñigo", "Álvarez", IN + "inigoalvarez", "inigo@alvarez.example", "Florin Security", "Head of Security", "22 Apr 2020"],
    ["Leela", "Rao", "", "", "Globex", "Director of Data", "30 May 2018"],
    ["Mara", "Quill", IN + "MaraQuill/?trk=contacts", "mara@quill.example", "Acme Corp", "Senior Engineer", "01 Jan 2023"],
]
SECOND = [
    ["Mara", "Quill", IN + "maraquill", "mara@quill.example", "Globex", "Principal Engineer", "01 Jan 2023"],
    ["Teo", "Brandt", IN + "teobrandt", "", "Larkspur, Inc.", "Director of Product", "15 Mar 2022"],
    *FIRST[2:11],
    ["Hana", "Sato", IN + "hanasato", "", "Globex", "Security Engineer", "02 Feb 2026"],
    ["Rolf", "Eng", IN + "rolfeng", "", "Acme Corp", "Recruiter", "20 Jan 2026"],
]
MALFORMED = (
    PREAMBLE + ",".join(f'"{h}"' for h in HEADER) + "\n"
    f'"Valid","Person","{IN}validperson","v@example.com","Acme Corp","Engineer","01 Jan 2023"\n'
    '"","","","","","",""\n"Short","Row"\n'
    f'"Extra","Columns","{IN}extra","e@example.com","Acme Corp","Engineer","01 Jan 2023","surplus"\n'
    f'"Unterminated,"Quote","{IN}uq","u@example.com","Acme","Eng","bogus-date"\n\n'
    f'"Last","Valid","{IN}lastvalid","l@example.com","Globex","Analyst","2024-05-05"\n'
)


def text(rows):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
    return out.getvalue()


def connections(rows, preamble=True):
    return (PREAMBLE if preamble else "") + text([HEADER, *rows])


PROFILE = text([
    ["First Name", "Last Name", "Maiden Name", "Headline", "Summary", "Industry", "Geo Location", "Twitter Handles", "Websites"],
    ["Robin", "Vale", "", "Engineering leader", "Builds teams.\nLikes long files.", "Software Development", "San Francisco Bay Area", "@rv", "https://rv.example"],
])
OTHERS = {
    "Positions.csv": text([
        ["Company Name", "Title", "Description", "Location", "Started On", "Finished On"],
        ["Globex", "VP Engineering", 'Leads "infra".', "San Francisco, CA", "Feb 2023", ""],
        ["Acme Corp", "Director of Engineering", "", "San Francisco, CA", "Mar 2019", "Jan 2023"],
        ["Rivermark Inc", "Senior Engineer", "", "Remote", "Jun 2015", "Feb 2019"]]),
    "Education.csv": text([
        ["School Name", "Start Date", "End Date", "Notes", "Degree Name", "Activities"],
        ["Hillside University", "2011", "2015", "", "BS", "ACM"], ["Night School", "2018", "2019", "", "Certificate", ""]]),
    "Skills.csv": text([["Name"], ["Distributed Systems"], ["Go"], ["PostgreSQL"], ["Leadership"]]),
    "Email Addresses.csv": text([["Email Address", "Confirmed", "Primary", "Updated On"], ["robin@vale.example", "Yes", "Yes", "2024-01-05"],
                                 ["rv@globex.example", "Yes", "No", "2024-06-11"]]),
    "PhoneNumbers.csv": text([["Extension", "Number", "Type"], ["", "+1 415 555 0101", "mobile"]]),
    "messages.csv": text([
        ["CONVERSATION ID", "CONVERSATION TITLE", "FROM", "SENDER PROFILE URL", "TO", "RECIPIENT PROFILE URLS", "DATE", "SUBJECT", "CONTENT", "FOLDER"],
        ["c-1", "", "Mara Quill", IN + "maraquill", "Robin Vale", IN + "robinvale", "2025-11-02 09:14:03 UTC", "", "Are you hiring?", "INBOX"],
        ["c-1", "", "Robin Vale", IN + "robinvale", "Mara Quill", IN + "maraquill", "2025-11-02 17:40:55 UTC", "", "We are.", "SENT"],
        ["c-2", "Intro", "Nadia Okoro", IN + "nadiaokoro", "Robin Vale", IN + "robinvale", "2019-04-18 11:00:00 UTC", "Intro", "Great to meet you,\nlet’s talk.", "INBOX"]]),
    "Invitations.csv": text([
        ["From", "To", "Sent At", "Message", "Direction", "inviterProfileUrl", "inviteeProfileUrl"],
        ["Robin Vale", "Hana Sato", "2026-01-28 10:00:00 UTC", "Hello.", "OUTGOING", IN + "robinvale", IN + "hanasato"]]),
    "Endorsement_Received_Info.csv": text([
        ["Endorsement Date", "Skill Name", "Endorser First Name", "Endorser Last Name", "Endorser Public Url", "Endorsement Status"],
        ["2024-03-11 08:00:00 UTC", "Distributed Systems", "Ivo", "Marsh", IN + "ivomarsh", "ACCEPTED"],
        ["2023-09-02 08:00:00 UTC", "Go", "Mara", "Quill", IN + "maraquill", "ACCEPTED"]]),
    "Recommendations_Received.csv": text([
        ["First Name", "Last Name", "Company", "Job Title", "Text", "Creation Date", "Status"],
        ["Nadia", "Okoro", "Acme Corp", "Engineering Manager", 'A rare, "systems-first" leader.', "2022-05-04", "VISIBLE"]]),
    "Company Follows.csv": text([["Organization", "Followed On"], ["Globex", "2023-02-01 00:00:00 UTC"], ["Paper Moon", "2021-11-19 00:00:00 UTC"]]),
    "Reactions.csv": text([["Date", "Type", "Link"], ["2025-12-01 08:00:00 UTC", "LIKE", "https://example.com/1"], ["2025-12-04 08:00:00 UTC", "PRAISE", "https://example.com/2"]]),
    "Comments.csv": text([["Date", "Link", "Message"], ["2025-12-02 08:00:00 UTC", "https://example.com/1", "Strong write-up."]]),
    "Shares.csv": text([["Date", "ShareLink", "ShareCommentary"], ["2025-12-03 08:00:00 UTC", "https://example.com/3", "Worth reading."]]),
    "Certifications.csv": text([["Name", "Authority"], ["Cloud Basics", "Northern Institute"], ["", "Nobody"], ["First Aid", ""]]),
    "Languages.csv": text([["Name", "Proficiency"], ["French", "Native"], ["Dutch", ""]]),
    "Projects.csv": text([["Title", "Started On", "Url"], ["Lighthouse", "2020", ""]]),
    "Honors.csv": text([["Title", "Issued On"], ["Best Talk", "2021"]]),
    "Courses.csv": text([["Name", "Number"], ["Statistics", "101"]]),
    "Volunteering.csv": text([["Company Name", "Role", "Cause", "Started On", "Finished On"], ["Food Bank", "Driver", "Hunger", "2020", "2021"], ["Tree Trust", "", "Climate", "2022", ""]]),
    "Recommendations_Given.csv": text([["First Name", "Last Name", "Company", "Job Title", "Text", "Creation Date"], ["Teo", "Brandt", "Larkspur", "PM", "Reliable.", "2023-01-01"]]),
    "jobs/Job Applications.csv": text([
        ["Application Date", "Contact Email", "Contact Phone Number", "Company Name", "Job Title", "Job Url", "Resume Name", "Question And Answers"],
        ["2/14/26", "", "", "Globex", "VP Platform", "https://example.com/jobs/1", "resume.pdf", ""]]),
    "jobs/Saved Jobs.csv": text([["Saved Date", "Job Url", "Job Title", "Company Name"], ["2026-02-10 00:00:00 UTC", "https://example.com/jobs/2", "Head of Infrastructure", "Paper Moon"]]),
}
JUNK = {
    "Ads Clicked.csv": text([["Date", "Ad Title"], ["2025-01-01", "Buy"]]), "Rich Media.csv": text([["Type", "Link"], ["PHOTO", "x"]]),
    "__MACOSX/._Connections.csv": "garbage", ".DS_Store": "garbage",
}
CORE = ["Positions.csv", "Education.csv", "Skills.csv", "Email Addresses.csv", "PhoneNumbers.csv", "messages.csv", "Invitations.csv",
        "Endorsement_Received_Info.csv", "Recommendations_Received.csv", "Company Follows.csv", "Reactions.csv", "Comments.csv",
        "jobs/Job Applications.csv", "jobs/Saved Jobs.csv"]


def export_files(rows=FIRST, profile=True, everything=False):
    files = {"Connections.csv": connections(rows), **{k: OTHERS[k] for k in (OTHERS if everything else CORE)}, **JUNK}
    if profile:
        files["Profile.csv"] = PROFILE
    return files


def zipped(files, folder="Export_2026-02-20/"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(zipfile.ZipInfo(folder + name), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()
